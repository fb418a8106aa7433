"""Plans of the load-signature engine."""
