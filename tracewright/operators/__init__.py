"""Operators over token traces."""
