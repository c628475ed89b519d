"""Physical patterns that Catalyst does not have, as compositions of DataFrame operations."""
