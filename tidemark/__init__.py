"""tidemark: batch and streaming analytics written directly on PySpark."""
