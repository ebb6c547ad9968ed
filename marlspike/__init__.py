"""marlspike: composable, deterministic DataFrame -> DataFrame operators for PySpark."""
