"""Structured Streaming twins of batch jobs."""
