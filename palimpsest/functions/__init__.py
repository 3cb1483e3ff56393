"""Column functions: text keys, scores, dates, JSON and HTML."""
