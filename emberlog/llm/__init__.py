"""Operators for preparing large training corpora, all as Spark jobs.

Nothing outside this subpackage imports it.
"""
