"""Readers, writers and the mapping of the driver tables to the package's schemas."""
