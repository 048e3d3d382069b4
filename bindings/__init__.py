"""Binds every operator to the benchmark tables, with the equivalent DuckDB SQL."""
