"""Document and grid analytics on Spark: spreadsheet formulas, rules, grids, layout and text as DataFrame operations."""
