"""Incremental forms of the daily merge and the status machine on Structured Streaming."""
