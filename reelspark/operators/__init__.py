"""Joins, windows and aggregates over capture tables."""
