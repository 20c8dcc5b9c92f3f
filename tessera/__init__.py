"""tessera: a Spark-native analytics engine for offer pages and text corpora."""
