"""Content-composition analytics as Spark DataFrame, SQL and streaming operators."""

__version__ = "0.1.0"
