"""Training-data operators. Nothing outside this subpackage imports it; it can be removed as a whole."""
