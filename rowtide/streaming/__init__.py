"""Incremental features over streams."""
