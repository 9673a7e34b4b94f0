"""Judging structured model outputs, and preparing training data, as Spark jobs."""
