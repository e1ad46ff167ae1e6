"""Operators for preparing language-model training data (nothing else in grantmill imports this)."""
