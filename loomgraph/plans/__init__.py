"""Query plans over the tables, by name, with the SQL they are checked against."""
