"""Affinity streaming."""
