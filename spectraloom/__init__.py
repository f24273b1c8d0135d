"""Spectral-imaging analytics as PySpark DataFrame operators.

One row per pixel, one array column per spectrum.  Every operator takes and
returns DataFrames; Catalyst plans the work, Spark shuffles it.
"""
