"""ledgerloom: Spark-native analytics over document-derived ledgers."""
