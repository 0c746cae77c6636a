"""Evidence retrieval and grounded calculation over filings, on Spark DataFrames."""

__version__ = "0.1.0"
