"""Readers, column resolution and result sinks."""
