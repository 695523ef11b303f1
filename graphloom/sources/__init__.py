"""Readers and the domain views of the input tables."""
