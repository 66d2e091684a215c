"""A Spark-native index, retrieval and graph engine over corpora of source and text files."""
