"""Streaming twins of the trace operators."""
