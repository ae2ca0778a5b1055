"""Readers, writers and archive checks."""
