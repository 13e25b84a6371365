"""Composite plans over the ledger tables."""
