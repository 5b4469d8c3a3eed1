"""Operators for building training corpora, each a set of Spark jobs.

Nothing else in the package imports this subpackage; it uses only the general
session helpers.  ``catalog`` names one query per operator.
"""
