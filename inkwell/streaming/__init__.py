"""Structured Streaming: the batch operators over arriving files."""
