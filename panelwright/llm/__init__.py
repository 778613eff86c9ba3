"""Operators for preparing training text and pages at scale, one module each."""
