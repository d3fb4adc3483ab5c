"""A corpus search and analytics engine on Spark: boolean queries over files and text records, lowered to DataFrames."""
