"""ledgerloom: a Spark-first engine for filing text, layout chunks, vector retrieval and answer checking."""

__version__ = "0.1.0"
