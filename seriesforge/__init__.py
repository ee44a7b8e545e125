"""Spark jobs over bulk statistical time series.

``sources``    schemas, readers, writers
``functions``  column expressions
``operators``  DataFrame -> DataFrame steps
``plans``      whole jobs made of the steps above
"""
