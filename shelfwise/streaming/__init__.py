"""shelfwise.streaming."""
