"""Readers of files, point tables, and snapshot differences."""
