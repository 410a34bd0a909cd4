"""Readers and writers of document sets and facts."""
