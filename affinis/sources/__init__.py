"""Readers and writers of record tables, match lists and submissions."""
