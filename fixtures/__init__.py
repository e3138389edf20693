"""Inputs for tests, correctness checks and the benchmark; never imported by the package."""
