"""factloom: evidence-attached facility analytics on PySpark."""
