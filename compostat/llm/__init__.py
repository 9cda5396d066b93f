"""Operators for preparing language-model training corpora.

Each module holds one operator with a general DataFrame interface; ``queries``
holds the thin registered queries.  Nothing outside this folder imports it.
"""
