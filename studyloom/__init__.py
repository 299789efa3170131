"""Spark-native engine for learning analytics, personalised retrieval and training-data preparation.

Every operator is a function from DataFrames to a DataFrame. Nothing in this package imports
``studyloom.llm``; that subpackage may be removed without breaking the rest.
"""

__version__ = "0.1.0"
