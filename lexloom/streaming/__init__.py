"""Structured Streaming counterparts of the batch annotations."""
