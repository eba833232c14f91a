"""Volumetric, vector and text analytics as Spark DataFrame operators."""
