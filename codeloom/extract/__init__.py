"""Symbol and reference extraction: one file row in, symbol and reference rows out (O-36 to O-47)."""
