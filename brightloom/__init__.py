"""Review and event analytics as composable PySpark DataFrame functions."""
