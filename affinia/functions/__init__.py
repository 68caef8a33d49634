"""Column functions of the recommendation engine."""
