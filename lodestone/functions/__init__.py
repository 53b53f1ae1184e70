"""Column functions: text scalars, predicates, tokenizers."""
