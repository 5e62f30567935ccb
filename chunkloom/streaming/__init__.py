"""Structured Streaming forms of the operators, each replayable as batch."""
