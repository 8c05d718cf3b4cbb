"""Classified-listing analytics as PySpark DataFrame operators."""
