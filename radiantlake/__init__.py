"""Spark-native analytics over tables of 3D scene primitives and their vectors."""
