"""lacewing: exact fuzzy name matching on Spark DataFrames."""

__version__ = "0.2.0"
