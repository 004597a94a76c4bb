"""Composite products, derived layers and whole jobs."""
