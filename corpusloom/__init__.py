"""corpusloom: a PySpark engine that prepares, audits and analyses language-model training data."""

__version__ = "0.1.0"
