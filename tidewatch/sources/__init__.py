"""Sources, views and sinks of panel data."""
