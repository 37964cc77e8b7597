"""Streams of dump files."""
