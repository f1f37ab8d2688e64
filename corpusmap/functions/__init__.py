"""Native Column expressions: text (SCA-*) and vectors (VEC-1/2, dot products)."""
