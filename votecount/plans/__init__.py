"""Reports built from operators."""
