"""Registered queries, their DuckDB oracles, and the mart refresh job."""
