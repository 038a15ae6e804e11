"""Streaming imports of arriving files."""
