"""codequarry: code retrieval, code-graph and event analytics on PySpark."""
