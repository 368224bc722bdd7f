"""Where the input tables and streams come from."""
