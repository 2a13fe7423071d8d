"""Readers: genotype exports and the public annotation tables."""
