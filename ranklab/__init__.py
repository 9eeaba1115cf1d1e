"""ranklab: recommender-system data work on Spark (profile, reshape, split, train, score, evaluate)."""
