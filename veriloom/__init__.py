"""Record verification on Spark: readings, extraction, rules, similarity, review and reporting as DataFrame operators."""
