"""Supervised scorers and unsupervised detectors on Spark ML and aggregates."""
