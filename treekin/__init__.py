"""Structural similarity analytics as Spark DataFrame plans."""
