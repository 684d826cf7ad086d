"""Variant-effect analytics expressed as Spark DataFrame plans."""
