"""corvane: corpus preparation, embedding and retrieval operators on PySpark."""

__version__ = "0.1.0"
