"""Audits of payment streams."""
