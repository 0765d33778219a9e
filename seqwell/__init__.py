"""A PySpark-native engine for ordered, typed sequences addressed by position."""
