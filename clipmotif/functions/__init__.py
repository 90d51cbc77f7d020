"""Column functions on nucleotide sequences and probabilities."""
