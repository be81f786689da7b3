"""Structured Streaming twins of the event memory."""
