"""Lead discovery over stored web data, written as Spark DataFrame operators."""

__version__ = "0.1.0"
