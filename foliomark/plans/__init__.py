"""Session handling, staged tables and the query catalogue."""
