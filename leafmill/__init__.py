"""leafmill: a Spark-native engine for page-text corpora and their processing logs."""
