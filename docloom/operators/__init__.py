"""Operators on typed and dynamic tables."""
