"""strandlake: a Spark-native engine for video bitstream analytics."""
