"""Column builders and the small array helpers used inside tasks."""
