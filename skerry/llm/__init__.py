"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
registered queries (``op1_...`` to ``op10_...``) and their SQL.
"""
