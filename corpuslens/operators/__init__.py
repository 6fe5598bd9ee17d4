"""Operators over the relation of lines."""
