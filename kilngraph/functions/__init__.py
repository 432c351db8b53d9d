"""Column functions: text, tables, ordered rules and the fixed values they read."""
