"""Structured Streaming views of the jobs."""
