"""Compositional, network and sequence analytics as Spark plans."""
