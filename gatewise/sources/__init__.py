"""Readers, writers and source normalisation."""
