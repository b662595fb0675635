"""assayer: turns collections of text records into ranked, auditable evidence on Spark."""

__version__ = "0.1.0"
