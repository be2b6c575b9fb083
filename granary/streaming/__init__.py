"""Incremental fits over streams."""
