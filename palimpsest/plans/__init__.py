"""Forensic queries as logical plans over ledger and edges."""
