"""Readers and writers of numeric matrices and of settings files."""
