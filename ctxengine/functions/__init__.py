"""Column functions: paths, texts and reply heuristics."""
