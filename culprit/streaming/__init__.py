"""Structured Streaming extensions; the batch operators serve both."""
