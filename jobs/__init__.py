"""Jobs that run from the command line; each one's work is a function that takes a session."""
