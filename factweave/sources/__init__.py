"""Readers of manuscripts and web pages."""
