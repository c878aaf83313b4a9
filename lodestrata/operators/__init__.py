"""Relational operators over archive layers."""
