"""tidewire: Spark-first analytics for public-discourse networks."""

__version__ = "0.1.0"
