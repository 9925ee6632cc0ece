"""Point-in-time market and macro panels as ordinary Spark DataFrame plans."""

__version__ = "0.1.0"
