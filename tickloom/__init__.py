"""Financial-econometrics jobs on Spark tables and streams."""
