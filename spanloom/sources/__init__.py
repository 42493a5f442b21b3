"""Readers of calendars, free/busy files, specifications and tables."""
