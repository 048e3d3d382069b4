"""Structured Streaming jobs over event logs and landing zones."""
