"""PySpark-native engine for probabilistic decision data."""
