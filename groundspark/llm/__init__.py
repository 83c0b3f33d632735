"""Operators and a pipeline for preparing training text."""
