"""Readers and writers of point files and scenes."""
