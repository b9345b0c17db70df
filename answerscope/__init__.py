"""Answer analytics on Spark: entity visibility, source mix and citation metrics as declarative DataFrame plans."""
