"""Operators on settings, prompts, requests, responses and text pairs."""
