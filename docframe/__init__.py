"""docframe: analysis and normalisation of structured specification documents on Spark."""
