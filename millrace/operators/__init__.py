"""Incremental-load operators, each ``DataFrame -> DataFrame``."""
