"""tarrafa: a PySpark-native engine for news events, crawled articles and text corpora."""

__version__ = "0.1.0"
