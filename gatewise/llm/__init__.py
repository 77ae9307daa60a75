"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it. Functions that run on executors are
shipped by value, so a cluster needs the third-party libraries only.
"""
