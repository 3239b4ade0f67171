"""A PySpark-native analytics engine for agent-experience and training data."""
