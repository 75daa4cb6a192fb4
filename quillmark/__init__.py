"""Pairwise-preference reward analytics and training-data operators on PySpark."""
