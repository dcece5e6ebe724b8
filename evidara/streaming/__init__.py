"""Structured Streaming and ordered state machines."""
