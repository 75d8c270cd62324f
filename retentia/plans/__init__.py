"""Reports, exploratory aggregates, evaluation and the risk model."""
