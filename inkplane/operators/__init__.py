"""Operators on DataFrames: character sets, labels, layouts, numbering, rasters."""
