"""The three end-to-end workflows, composed from the operators."""
