"""Corpus operators for large training-text tables; nothing else in the package imports this."""
