"""Change feeds, cursors and replication."""
