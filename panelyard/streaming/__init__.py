"""Micro-batch operators."""
