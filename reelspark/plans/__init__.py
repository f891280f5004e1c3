"""End-to-end query paths composed from the operators."""
