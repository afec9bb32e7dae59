"""Corpus and rollout analytics on PySpark."""
