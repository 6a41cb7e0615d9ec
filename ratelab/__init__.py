"""Group-fairness analysis of automatic speech ratings, as Spark DataFrame jobs."""
