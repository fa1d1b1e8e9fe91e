"""Operators for building language-model training corpora.

Every operator takes DataFrames with configurable column names and returns DataFrames; the
``opN_`` queries in :mod:`plumbline.llm.queries` are thin layers over them.  Nothing outside this
subpackage imports it.
"""
