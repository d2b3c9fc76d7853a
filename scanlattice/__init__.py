"""Sparse scan-and-diffraction analytics on Spark DataFrames."""
