"""loglattice: a Spark-native analytics engine for blockchain event logs."""
