"""Operators for preparing text for language-model training.

Nothing else in the package imports this folder.
"""
