"""Matrices assembled from streams."""
