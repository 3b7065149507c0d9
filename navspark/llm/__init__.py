"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface
and the thin ``opN_<name>`` query that derives digest columns from it.
"""
