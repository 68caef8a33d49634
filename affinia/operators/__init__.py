"""DataFrame operators of the recommendation engine."""
