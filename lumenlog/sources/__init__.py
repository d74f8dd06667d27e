"""Where log lines come from."""
