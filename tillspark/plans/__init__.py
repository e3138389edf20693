"""Reporting views and the catalogue of named business questions."""
