"""Structured Streaming forms of the time-bin counts and of applying fitted statistics."""
