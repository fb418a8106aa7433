"""Sources of the load-signature engine."""
