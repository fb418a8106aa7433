"""Functions of the load-signature engine."""
