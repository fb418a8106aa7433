"""Streaming of the load-signature engine."""
