"""Personal-finance analytics on Spark, for all users in one pass."""

__version__ = "0.1.0"
