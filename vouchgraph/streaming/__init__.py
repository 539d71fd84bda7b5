"""Structured Streaming over operation logs."""
