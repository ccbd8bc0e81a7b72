"""granary: Spark-native analytics for curating and evaluating language-model corpora."""
