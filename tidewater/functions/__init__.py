"""Column factories: text, dates, scores, arrays and JSON."""
