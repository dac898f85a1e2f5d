"""Operators for preparing training text at scale; see queries.py for the registered ones."""
