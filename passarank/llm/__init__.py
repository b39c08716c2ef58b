"""Operators of a training-data pipeline over whole tables, one module each.

Nothing else in the library imports this package. Every operator takes and returns DataFrames; what
runs inside tasks works on Arrow batches with numpy and holds one bounded slice of a batch at a time.
"""
