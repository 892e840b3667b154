"""Operators of a training-data pipeline: scans, joins, scoring, tokens and formats over whole text tables."""
