"""Readers for the domain's text formats and the matching sinks."""
