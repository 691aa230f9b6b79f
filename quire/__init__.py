"""Spark jobs that turn positioned text into clean typed records and score them."""
