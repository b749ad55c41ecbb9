"""Readers, writers and the bucketed table store."""
