"""Operators over whole tables: windows, as-of matching, statistics, replay."""
