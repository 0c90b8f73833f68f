"""Scattering models and their inversion from volume backscatter at several frequencies."""
