"""propspark: tabular property prediction as Spark DataFrame jobs."""
