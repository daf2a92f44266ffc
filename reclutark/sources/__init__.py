"""Readers, writers, batch appends, the bulk import, and the fixture adapters."""
