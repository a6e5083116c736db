"""Reading and writing price tables."""
