"""Readers, writers and row hydration."""
