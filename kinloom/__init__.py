"""Kinloom: record linkage and corpus preparation as lazy Spark plans."""
