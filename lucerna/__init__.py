"""lucerna: a Spark-native engine for language-model evaluation data."""
