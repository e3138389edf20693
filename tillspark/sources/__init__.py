"""Readers, writers and the shared working folder."""
