"""tidemark: daily metric series, ranked against their own history, on Spark DataFrames."""

__version__ = "0.1.0"
