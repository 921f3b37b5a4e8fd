"""barlight: event-window analytics over daily series and short texts, built on Spark DataFrames."""

__version__ = "0.1.0"
