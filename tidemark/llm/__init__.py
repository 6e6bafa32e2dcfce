"""Operators for preparing language-model training corpora at scale.

Nothing in the rest of the library imports this subpackage.
"""
