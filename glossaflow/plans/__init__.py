"""Whole plans: the translation of a collection, reports, and the catalogue of queries."""
