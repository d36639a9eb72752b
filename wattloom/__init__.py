"""Power-transfer and market analytics as PySpark DataFrame operators."""
