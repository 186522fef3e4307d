"""Data profiling, preparation and model selection on Spark."""
