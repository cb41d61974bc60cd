"""Multi-model analytics over whole datasets on PySpark."""
