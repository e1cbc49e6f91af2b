"""Object-detection data processing on Apache Spark DataFrames and streams."""

__version__ = "0.1.0"
