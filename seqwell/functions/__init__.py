"""Types, literals and scalar operators."""
