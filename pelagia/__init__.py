"""Acoustic-trawl survey analytics expressed as Spark DataFrame plans."""
