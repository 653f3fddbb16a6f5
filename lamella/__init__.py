"""Document-layout analytics on PySpark."""
