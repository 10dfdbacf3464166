"""Operators over tables of primitives, metrics and cameras."""
