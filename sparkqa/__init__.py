"""Spark jobs for answering questions over uploaded tables and documents at scale."""
