"""Coastal water-level analytics as Spark DataFrame operators."""
