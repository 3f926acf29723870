"""ticketspark: a PySpark engine for cleaning complaint tickets and finding recurring events."""
