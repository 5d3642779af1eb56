"""Column functions: difficulty, weights, knowledge-tracing steps, texts."""
