"""Session and event analytics as PySpark DataFrame operators."""
