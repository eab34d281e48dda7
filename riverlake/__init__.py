"""A Spark-native lake of river-gauge readings."""
