"""Spark jobs that check service zones against address registers and published rules."""
