"""Scholia: document retrieval and study analytics as PySpark DataFrame plans."""
