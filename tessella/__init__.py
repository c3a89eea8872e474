"""A Spark-native analytics engine for behavioral records and conversational text."""
