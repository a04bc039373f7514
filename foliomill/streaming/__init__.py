"""Continuous runs over arriving manifests."""
