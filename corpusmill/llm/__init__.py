"""Operators for training-data pipelines: filters, dedup, extraction, formatting.

Nothing outside this subpackage imports it; ``queries`` lists what it registers.
"""
