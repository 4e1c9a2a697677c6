"""Gridded climate-risk analytics on Spark DataFrames.

A raster is a table of cells, a mask is a predicate, a zonal statistic is a grouped aggregate, and a global
statistic that rescales a layer is an aggregate of one row (or one per group) joined back.
"""
