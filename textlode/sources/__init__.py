"""Readers and writers for the supported corpus formats."""
