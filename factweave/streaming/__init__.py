"""Operators over edit streams."""
