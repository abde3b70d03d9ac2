"""Column expressions: text, probabilities, vectors, binning."""
