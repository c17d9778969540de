"""Streaming transformations (they also run on batches) and the jobs around them."""
