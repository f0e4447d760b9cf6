"""Registered queries and their checking SQL."""
