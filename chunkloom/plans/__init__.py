"""Registered queries, their table adapters and their SQL checks."""
