"""Spatio-temporal tracking analytics on Spark."""
