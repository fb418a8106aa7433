"""Operators of the load-signature engine."""
