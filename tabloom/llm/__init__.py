"""Operators for preparing language-model training data: text classifiers, deduplication, vector search, packing, archives.

Nothing else in the library imports this package. Every operator takes and returns DataFrames; its docstring states what it does with
NULLs, empty and very long texts, ties, repeated rows and empty tables. Columns that an operator does not name are ignored, so extra
columns cannot clash.
"""
