"""Batch operators over transaction tables."""
