"""Decisions taken on the driver from a few evidence rows: roles, key figures, charts."""
