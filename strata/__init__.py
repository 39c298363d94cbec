"""Architecture analytics of source-code collections as PySpark DataFrame operators."""

__version__ = "0.1.0"
