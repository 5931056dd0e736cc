"""Adapters, queries and their SQL."""
