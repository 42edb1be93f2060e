"""Reading and rendering log lines."""
