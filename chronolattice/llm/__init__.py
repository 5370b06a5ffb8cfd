"""Operators for training-data pipelines (text, URL, media and embedding tables).

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`chronolattice.llm.queries` derives the
registered ``opN_*`` queries from them.
"""
