"""Incremental document indexing and similarity retrieval as PySpark jobs."""
