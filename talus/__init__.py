"""Slope-hazard analytics and text-collection operators as PySpark DataFrame functions."""
