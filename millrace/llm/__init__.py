"""Operators for large text corpora and numeric columns of model runs; nothing outside of this package imports it."""
