"""Structured Streaming upserts."""
