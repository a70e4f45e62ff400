"""DataFrame-to-DataFrame steps: cleaning, features, learners, metrics and collection."""
