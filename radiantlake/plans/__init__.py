"""Whole codecs and registered queries."""
