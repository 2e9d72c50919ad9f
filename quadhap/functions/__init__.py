"""Column expressions: names, sequences, alignments, doses."""
