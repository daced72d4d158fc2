"""Part of larkspur: sources."""
