"""Reading, writing, normalizing and importing traces."""
