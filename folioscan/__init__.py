"""folioscan: index and search tables of documents with Spark DataFrames.

Rows become documents (``sources``), documents become field rows, wide search
tables and postings (``operators``), and search requests become boolean
``Column`` predicates, scores and top-k queries. ``plans`` holds the registered
example queries, ``streaming`` the continuous upsert.
"""

from folioscan.definition import IndexDefinition, Indexing, Sort, Storage

__all__ = ["IndexDefinition", "Indexing", "Sort", "Storage"]
