"""Column expressions: number cells, vectors, distances, kernels, activations, order keys."""
