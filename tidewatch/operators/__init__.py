"""Transforms of series, scores and segments."""
