"""Column expressions: text, ratings, review-site rules and the page parser."""
