"""Column functions: text, model output, decision rules."""
