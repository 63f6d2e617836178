"""kadastra: a Spark-native analytics engine for property listings and corpora."""
