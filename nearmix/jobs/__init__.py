"""Batch jobs for spark-submit: values, keys, index."""
