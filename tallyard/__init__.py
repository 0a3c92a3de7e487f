"""Catalogue and inventory analytics expressed as Spark DataFrame jobs."""
