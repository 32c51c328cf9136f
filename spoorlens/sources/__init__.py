"""Readers, sinks and written stages."""
