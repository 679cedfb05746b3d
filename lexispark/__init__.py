"""Text analytics on Spark DataFrames: curation, cleaning, features, models, assessment."""
