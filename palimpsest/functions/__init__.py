"""Subpackage of palimpsest."""
