"""Loomery: documents, vectors and knowledge graphs as plain PySpark DataFrames."""
