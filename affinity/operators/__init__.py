"""Affinity operators."""
