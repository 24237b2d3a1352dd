"""Training-data operators: ten numbered queries and the pipeline built from them."""
