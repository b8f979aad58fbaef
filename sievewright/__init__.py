"""Screening of text and media records on Spark: evidence signals, scores, metrics, fusion."""
