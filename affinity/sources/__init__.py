"""Affinity sources."""
