"""Profiling, preparation, models and search as DataFrame operators."""
