"""Operators for text corpora used in language-model training. Nothing outside imports this."""
