"""Jobs to run from the command line, and their registered queries."""
