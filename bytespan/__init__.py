"""Byte- and text-level analytics over blobs, documents and archives, on Spark."""
