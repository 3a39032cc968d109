"""Readers and writers of frames, tags and reports."""
