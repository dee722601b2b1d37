"""Whole plans: the localisation run, its diagnostics, and the driver's queries."""
