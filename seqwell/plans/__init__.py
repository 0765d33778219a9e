"""Piece tables and the statement language."""
