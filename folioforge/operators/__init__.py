"""Relational, text and graph operators over archive tables."""
