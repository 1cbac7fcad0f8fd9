"""Spark toolkit for building-energy and control time series."""
