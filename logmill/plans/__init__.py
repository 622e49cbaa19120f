"""Profile catalog, its compilation to columns, and test-log views."""
