"""Retrieval analytics on Spark: ingest, chunk, index, retrieve, pack, remember."""
