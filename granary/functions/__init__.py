"""Column functions: activations, loss surfaces, metrics, validation, formatting."""
