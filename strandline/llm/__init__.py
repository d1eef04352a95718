"""Operators for preparing large text corpora, each one a Spark job.

Every operator takes and returns DataFrames.  Nothing outside this
subpackage imports it, so it can be left out of an installation.
"""
