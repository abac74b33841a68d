"""Training, evaluation and explanation of the conversion classifier."""
