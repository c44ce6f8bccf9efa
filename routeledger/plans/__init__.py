"""Contracts, and the queries with their DuckDB SQL."""
