"""Column functions and the SQL dialect shared by Spark and the SQL check."""
