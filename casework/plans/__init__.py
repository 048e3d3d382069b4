"""Catalogs, rule tables and end-to-end parse plans."""
