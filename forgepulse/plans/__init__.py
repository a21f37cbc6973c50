"""Reads: filters, pages and joins over the tables."""
