"""Structured Streaming versions of the line source, event assembly and windowed counts."""
