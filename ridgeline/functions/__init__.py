"""Column functions: geodesy, text and documents, colours."""
