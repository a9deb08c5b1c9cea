"""Column expressions: request features, text normalisation, match predicates, encoders."""
