"""Corpus analytics on Spark: DataFrame operators for cleaning, screening, sampling and measuring text corpora."""

__version__ = "0.1.0"
