"""Readers of raw events, and writers of tables and change topics."""
