"""Affinity plans."""
