"""Operators over tables: reassembly, windows, correction, joins, enrichment."""
