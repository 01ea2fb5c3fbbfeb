"""Passive-radio sighting analytics as a library of Spark DataFrame operators."""
