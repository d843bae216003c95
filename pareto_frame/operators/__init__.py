"""Relational building blocks of the skyline plans."""
