"""spotweave: molecule analytics for spatial imaging, written for Spark DataFrames."""

__version__ = "0.1.0"
