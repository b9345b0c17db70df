"""Column functions: text, URLs, entities, pages, numbers."""
