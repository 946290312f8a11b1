"""Operators of a training-data pipeline: joins, coders, classifiers, search and formatting."""
