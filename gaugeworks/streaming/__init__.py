"""Counts that grow with a stream of pairs."""
