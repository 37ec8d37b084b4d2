"""Readers, writers and matrices made from tables."""
