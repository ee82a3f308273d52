"""A linguistic-annotation analytics engine on PySpark."""
