"""Composed modes, by name."""
