"""Small NumPy helpers that run inside Arrow batches. Nothing here knows Spark."""
