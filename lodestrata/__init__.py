"""A Spark-native analytics engine over nested binary archives and large text corpora."""
