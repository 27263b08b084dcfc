"""Operators for preparing training text: dedup, decontamination, filters, token files, archives."""
