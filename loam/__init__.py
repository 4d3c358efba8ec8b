"""Retrieval, chunking and corpus jobs written as Spark DataFrame plans."""
