"""Operators for preparing large text collections: scoring, scanning, deduplication and mixing.

Every operator is a function from DataFrame to DataFrame. Nothing outside this
subpackage imports it.
"""
