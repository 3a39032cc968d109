"""Incremental pass 1: per-frame measures of files as they arrive."""
