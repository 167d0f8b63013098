"""Column functions: exact decimal rounding, text formats, dates, list ordering."""
