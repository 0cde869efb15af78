"""Operators for large text corpora: dedup, formatting, decontamination, scoring and token files.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
