"""Spark-first analytics for a standards body's register, mail and proposals."""
