"""Terravane: named datasets, declarative tasks and geo analytics on Spark DataFrames."""

__version__ = "0.1.0"
