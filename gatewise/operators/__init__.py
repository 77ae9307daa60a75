"""Batch operators over observations, tracks and control tables."""
