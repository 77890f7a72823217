"""Reading and writing tables, and the registry of feature sources."""
