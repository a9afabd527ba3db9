"""Search, analytics and data-preparation operators declared as Spark DataFrame plans."""

__version__ = "0.1.0"
