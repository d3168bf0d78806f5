"""rankatlas: local-search ranking analytics on PySpark."""
