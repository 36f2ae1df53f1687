"""Schemas, provider file readers, table writers and extracts."""
