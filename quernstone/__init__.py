"""Analytics over listings that are observed again and again, declared as Spark plans."""

__version__ = "0.1.0"
