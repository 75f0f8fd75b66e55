"""Skerry: document retrieval and text processing as PySpark DataFrame plans."""
