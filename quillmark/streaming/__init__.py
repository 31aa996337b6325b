"""Structured Streaming forms of the record-at-a-time evaluation."""
