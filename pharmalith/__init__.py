"""A Spark-native engine for clinical-pharmacology data preparation."""
