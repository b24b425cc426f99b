"""A PySpark-native engine for conversation memory and for corpora of training data."""
