"""Readers, file checks, table ranking and the report bundle."""
