"""Column helpers, statistical tails and distributed ranking."""
