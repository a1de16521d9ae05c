"""Incremental loads driven by a stream of arriving files."""
