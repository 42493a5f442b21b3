"""Continuous variants of the batch operators."""
