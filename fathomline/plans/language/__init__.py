"""A small read-only graph query language: text to syntax tree, checks and rewrites on the tree, tree to DataFrame."""
