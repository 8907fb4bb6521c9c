"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` derives the registered ``opN_*`` queries.
"""
