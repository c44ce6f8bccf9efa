"""Readers of spans and adapters of other tables to their shape."""
