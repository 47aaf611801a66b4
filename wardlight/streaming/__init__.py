"""Structured Streaming forms of the live queries."""
