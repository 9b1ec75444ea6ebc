"""chartloom: a Spark-first analytics engine for clinical text."""

__version__ = "0.1.0"
