"""Physical-plan helpers shared by the operators: skew-safe joins, checkpoints, table access."""
