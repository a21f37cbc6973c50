"""Batch operators over events and their tables."""
