"""Training-data operators, each a Spark job over whole texts."""
