"""Scalar column functions: text, URL, term matching and scoring expressions."""
