"""Operators for large text collections: deduplication, scoring, mixing, archives.

Nothing outside this subpackage imports it.  ``queries.py`` and ``oracle.py``
hold the registered queries and their SQL counterparts.
"""
