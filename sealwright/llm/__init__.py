"""Operators for preparing training text: filters, near copies, search, archives, models, packing, extraction."""
