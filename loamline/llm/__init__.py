"""Training-data pipeline operators: ten operators on text tables, each a Spark job."""
