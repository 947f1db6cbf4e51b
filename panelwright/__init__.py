"""Panel and cohort analytics as PySpark DataFrame operators."""
