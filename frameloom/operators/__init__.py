"""Operators over frames, cells, stars, transforms and images."""
