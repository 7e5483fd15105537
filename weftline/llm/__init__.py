"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  ``registry`` lists the queries
and their SQL; every operator module has its own DataFrame interface.
"""
