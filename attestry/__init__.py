"""Attestry: a Spark-native engine for source corroboration and large text corpora."""
