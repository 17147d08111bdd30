"""Streams of page results."""
