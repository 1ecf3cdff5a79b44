"""Queries over the driver's tables and the analog views they read."""
