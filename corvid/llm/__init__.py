"""Operators for preparing language-model training data; nothing else in corvid imports them."""
