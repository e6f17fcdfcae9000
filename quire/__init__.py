"""quire: PySpark jobs that turn page-structured documents into clean, ordered, linked text."""

__version__ = "0.1.0"
