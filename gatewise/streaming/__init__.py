"""Structured Streaming form of the counter."""
