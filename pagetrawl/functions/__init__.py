"""Column functions: columns in, column out, all evaluated by Spark."""
