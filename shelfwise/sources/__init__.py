"""shelfwise.sources."""
