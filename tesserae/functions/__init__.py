"""Subpackage of the tile analytics engine."""
