"""Readers, writers and schema resolution."""
