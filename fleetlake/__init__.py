"""Spark jobs over fleet patch state, app catalogs and training-data corpora."""
