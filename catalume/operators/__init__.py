"""Catalogue operators as DataFrame transformations."""
