"""Training-data operators: ten operators, their thin ``opN_*`` queries and their SQL."""
