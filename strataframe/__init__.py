"""A Spark-native document graph, retrieval and analytics engine: everything is DataFrame in, DataFrame out."""
