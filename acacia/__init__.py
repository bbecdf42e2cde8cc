"""Conservation-monitoring analytics on PySpark."""
