"""Relational operators of a reconciliation: audits, matching passes, checks, posting, scoring, reports."""
