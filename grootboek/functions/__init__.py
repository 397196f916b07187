"""Column expressions: text, money, ids and dates."""
