"""A Spark-first engine for cleaning, comparing and analysing text corpora and taxonomies."""

__version__ = "0.1.0"
