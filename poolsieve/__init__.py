"""A PySpark engine for pool-based data selection over text corpora."""
