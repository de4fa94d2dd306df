"""Queries and update programs as checked plans."""
