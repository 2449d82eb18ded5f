"""Whole plans: the catalogue facade and the registered queries."""
