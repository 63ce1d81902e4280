"""Lectern: document collections to clean, narratable text, as Spark DataFrame transforms."""
