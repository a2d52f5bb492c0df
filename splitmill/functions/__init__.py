"""Column helpers: IEEE-style division, closeness, distribution tails, text."""
