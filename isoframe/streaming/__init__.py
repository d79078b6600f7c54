"""Incremental work over newly arriving tables."""
