"""Operators for preparing training data at corpus scale.

Every module holds one operator that takes and returns DataFrames; ``queries``
binds them to the tables of a data folder and ``sql`` holds the plain SQL
that the same results can be checked with.  Nothing outside this subpackage
imports it.
"""
