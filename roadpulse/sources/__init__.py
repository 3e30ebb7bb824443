"""Reading and writing the logs and the history."""
