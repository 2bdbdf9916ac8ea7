"""Readers, writers and validation of stored records."""
