"""Training-data operators over the tables documents, pages, benchmark and labels.

Each module holds one operator with a general interface; ``queries`` derives the
registered ``opN_*`` queries from them. Nothing outside this subpackage imports it.
"""
