"""strataq: a memory, retrieval and graph analytics engine written for Spark DataFrames."""

__version__ = "0.1.0"
