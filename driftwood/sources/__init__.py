"""Readers and parsers of recorded inputs, and sinks."""
