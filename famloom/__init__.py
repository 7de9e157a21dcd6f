"""Protein-family analytics as PySpark DataFrame operators."""
