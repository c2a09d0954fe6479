"""Queries over the supplied tables, each with its SQL."""
