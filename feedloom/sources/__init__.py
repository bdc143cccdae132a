"""Readers that turn files, tables and hosts into document rows."""
