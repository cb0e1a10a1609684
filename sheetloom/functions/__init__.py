"""Cell-level expressions: numbers, blanks, text forms, dates, conditions."""
