"""Stored variables: files, catalog, transactions, byte facade."""
