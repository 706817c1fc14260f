"""shelfwise.functions."""
