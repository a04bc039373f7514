"""Batch plans: what to run, in which order, and how the outcomes settle."""
