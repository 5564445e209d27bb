"""Column functions: text normalisation, terms, and scores. All stay inside Catalyst."""
