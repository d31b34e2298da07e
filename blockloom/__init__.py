"""blockloom: block-level dedupe and versioned-storage analytics on PySpark."""
