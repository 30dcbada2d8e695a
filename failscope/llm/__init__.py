"""Operators for large training corpora, with their queries in ``queries``."""
