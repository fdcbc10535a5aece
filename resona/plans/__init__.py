"""Composite, user-facing pipelines."""
