"""shelfwise.operators."""
