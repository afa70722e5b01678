"""Catalogue operators on streams; each has a batch twin that gives the same."""
