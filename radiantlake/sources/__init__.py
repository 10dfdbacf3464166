"""Files: PLY, reconstructions, JSON beside scenes, array containers."""
