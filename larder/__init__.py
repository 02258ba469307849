"""larder: price, catalogue, basket and proximity jobs for grocery-style data, as Spark DataFrames."""
