"""Spark-first analytics for stored product-catalog pages, jobs, images and logs."""
