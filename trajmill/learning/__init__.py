"""Linear verifiers trained with MLlib."""
