"""Exact linear algebra over DataFrames, planned by Catalyst."""
