"""The worked analyses, composed from the operators."""
