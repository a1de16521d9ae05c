"""Small helpers shared by the operators: keys, SQL text, transforms, shared folders."""
