"""Behaviour events as a stream."""
