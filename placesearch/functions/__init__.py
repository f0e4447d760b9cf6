"""Column functions: Column in, Column out, no rows moved."""
