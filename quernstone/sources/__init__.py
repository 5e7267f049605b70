"""Readers of every input form, and writers of every output form."""
