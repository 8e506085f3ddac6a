"""tablelab: profile, clean, explore and model tables with Spark DataFrames."""

__version__ = "0.1.0"
