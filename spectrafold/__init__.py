"""spectrafold: a Spark-native catalogue query and data-processing engine."""
