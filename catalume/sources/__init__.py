"""Readers of folders, (nested) archives, media headers and encoders."""
