"""Readers and writers of record datasets."""
