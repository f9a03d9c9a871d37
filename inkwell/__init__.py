"""Text analytics on PySpark: indexing, ranked search, vectors, hierarchies and nested records."""
