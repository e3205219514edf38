"""Readers, writers and generators of settlement data."""
