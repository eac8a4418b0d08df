"""Operators for preparing text corpora, one module each; their registered queries are in ``queries``."""
