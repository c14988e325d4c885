"""quern: a PySpark-native analytics engine for tabular and omics-style data."""
