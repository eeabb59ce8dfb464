"""Structured Streaming over event tables and document revisions."""
