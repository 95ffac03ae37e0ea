"""Readers, sinks and the bindings of driver tables to listing roles."""
