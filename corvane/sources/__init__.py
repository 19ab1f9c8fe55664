"""Readers and writers: keyed tables, CSV sheets, archives, page and export adapters."""
