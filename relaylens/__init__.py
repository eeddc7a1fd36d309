"""relaylens: analytics for stream mirroring, written as Spark DataFrame operators."""

__version__ = "0.1.0"
