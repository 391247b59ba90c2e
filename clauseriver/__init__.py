"""Corpus-scale policy-risk analytics as Spark DataFrame operators."""
