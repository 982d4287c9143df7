"""Spark-native curation of sample-by-probe studies and evaluation of linear models on them."""
