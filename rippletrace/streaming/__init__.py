"""Incremental runs over arriving changes."""
