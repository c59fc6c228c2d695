"""Queries over the shared test tables."""
