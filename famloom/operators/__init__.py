"""Distributed operators: intervals, joins, graphs, runs, updates."""
