"""Column expressions: text, dates, URLs and the fixed value lists they use."""
