"""The three end-to-end jobs, composed of operators."""
