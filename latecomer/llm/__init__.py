"""Operators for large text corpora (near duplicates, tokens, licences, HTML, quality ...).

Nothing else in the library imports this subpackage; it may import general helpers.
"""
