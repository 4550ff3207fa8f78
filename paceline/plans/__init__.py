"""Ready-made analyses over the operators."""
