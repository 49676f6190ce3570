"""Operators that prepare training corpora: dedup, scans, archives, token ids, mixing and search.

Nothing outside this subpackage imports it.
"""
