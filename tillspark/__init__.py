"""Retail invoice analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames; nothing in the package starts a
session, reads a file of its own or keeps global state.
"""
