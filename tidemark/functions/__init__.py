"""Column functions over URLs, paths, headers and sizes: Column in, Column out."""
