"""Corpus-preparation operators for large text collections.

Every operator takes and returns DataFrames. Nothing outside this folder
imports it.
"""
