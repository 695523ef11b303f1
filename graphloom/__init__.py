"""Catalogue, knowledge-graph and recommendation analytics as DataFrame functions."""
