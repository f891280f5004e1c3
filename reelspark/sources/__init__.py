"""Readers that turn recording files into tables."""
