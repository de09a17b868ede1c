"""Column functions: text rules, legal references and dates, vectors."""
