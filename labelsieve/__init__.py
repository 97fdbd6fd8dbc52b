"""Label-leakage audit, dataset cleaning and honest model evaluation on Spark."""
