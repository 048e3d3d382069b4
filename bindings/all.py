"""Imports every binding module, so that all queries are registered."""

from bindings import discovery, io, logs, ranges, scalars, tables  # noqa: F401
