"""Sparse-matrix analytics on Spark: matrices are DataFrames of (r, c, v)."""

from matrel.operators.coo import Matrix
from matrel.operators.multiply import multiply
from matrel.sources.matrix_market import read_matrix_market

__all__ = ["Matrix", "multiply", "read_matrix_market"]
