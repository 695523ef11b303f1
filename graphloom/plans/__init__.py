"""Queries over the domain views, each with the same query in SQL."""
