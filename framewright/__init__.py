"""A dataframe analytics engine on Spark: every operator is a lazy plan of DataFrame and Column primitives."""
