"""Operators on streams, with batch twins."""
