"""Columns that the provenance operators use: row ids and keys."""
