"""gramloom: learning and applying sparse n-gram classifiers over token sequences with Spark DataFrames."""

__version__ = "0.1.0"
