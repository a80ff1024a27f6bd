"""loamwork: contig-style record grouping, quality and repeat analytics on PySpark."""
