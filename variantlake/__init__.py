"""Cohort-scale annotation of personal genotype data on Spark."""
