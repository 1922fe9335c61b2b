"""Tick and bar lakes on Spark."""
