"""Claim grounding and verification analytics over knowledge graphs, as PySpark DataFrame plans."""
