"""A PySpark-native engine for decision-model data."""
