"""Readers and versioned dictionaries."""
