"""Column expressions: text, domain tables, vectors and plane geometry."""
