"""Operators that prepare the texts and measurements of audits as training data."""
