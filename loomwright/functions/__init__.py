"""Column functions: numbers, text, multi-value cells, phones, dates and validators. All are Spark expressions."""
