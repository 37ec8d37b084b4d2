"""Small pure functions."""
