"""Keystrata: single-table data designs as Spark DataFrame plans."""
