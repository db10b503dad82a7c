"""tabspark: typed tables from delimited text, and data preparation at scale, as Spark DataFrame plans."""

__version__ = "0.1.0"
