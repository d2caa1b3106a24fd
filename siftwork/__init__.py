"""Dataset integrity and classifier evaluation on Spark."""
