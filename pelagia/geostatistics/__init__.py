"""Variograms, kriging, projection and cropping."""
