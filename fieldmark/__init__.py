"""A PySpark engine for evidence-first business-record research."""
