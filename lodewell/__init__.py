"""Document, vector and graph analytics as composable PySpark DataFrame operators."""
