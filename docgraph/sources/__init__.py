"""Readers and writers of the pipelines' files."""
