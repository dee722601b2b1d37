"""Acoustic localisation analytics on Spark."""
