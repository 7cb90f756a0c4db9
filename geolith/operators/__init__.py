"""Operators over feature tables: every one takes and gives DataFrames."""
