"""Fitted projections on streams, and shared storage for cut lineage."""
