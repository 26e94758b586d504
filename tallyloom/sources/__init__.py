"""Readers that keep malformed rows visible, and sinks that refuse to publish half a result."""
