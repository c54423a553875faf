"""Operators for preparing training data: text, conversations, pages and vectors.

Nothing outside this subpackage imports it.  Each module holds one operator;
``catalog`` names the queries and ``store`` the checkpoint handling.
"""
