"""Operators for preparing training corpora (kept apart from the variant engine)."""
