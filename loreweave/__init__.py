"""loreweave: knowledge-base analytics as PySpark DataFrame jobs."""
