"""Plans: an import specification compiled to DataFrames, and the guard of the SQL surface."""
