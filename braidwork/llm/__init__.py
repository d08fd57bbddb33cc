"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator; `queries` binds them to the standard tables and `scratch`, `words`
and `components` are shared helpers.
"""
