"""Operators of a training-data pipeline: decontamination, joins, packing, scoring, filters."""
