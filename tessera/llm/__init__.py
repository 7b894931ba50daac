"""Training-data operators: extraction, tokenising, privacy, quality, search, dedup, packing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames and selects the columns it needs by name, so extra columns in its
input never reach (or clash with) its internals.
"""
