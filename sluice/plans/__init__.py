"""Route configurations and the plans they compile to."""
