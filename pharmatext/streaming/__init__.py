"""Structured Streaming forms of collecting and scoring."""
