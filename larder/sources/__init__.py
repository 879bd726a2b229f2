"""Readers with pinned schemas, and sinks."""
