"""Sensor-network analytics expressed as Spark DataFrame transformations."""
