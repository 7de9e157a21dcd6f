"""Readers for the file formats the jobs consume."""
