"""User-level jobs composed from sources, functions and operators."""
