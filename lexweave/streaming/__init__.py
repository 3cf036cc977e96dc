"""Streams of exam responses."""
