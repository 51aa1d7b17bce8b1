"""Operators for preparing training data: filters, near duplicates, scans, search, archives, packing.

Nothing else in the library imports this subpackage.
"""
