"""Raster, vector and rule operators on DataFrames."""
