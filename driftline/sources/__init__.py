"""Readers, writers and row normalisation."""
