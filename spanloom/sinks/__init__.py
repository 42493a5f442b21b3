"""Writers of reports and free/busy calendars."""
