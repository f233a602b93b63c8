"""assayer: decision-data curation and evaluation analytics on Spark."""
