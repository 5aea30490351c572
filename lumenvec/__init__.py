"""Query engine over vectors and metadata, on Spark."""
