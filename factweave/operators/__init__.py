"""Operators over the canonical tables."""
