"""Operators over spans, runs, routes and releases."""
