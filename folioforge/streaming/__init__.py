"""Stateful request processing."""
