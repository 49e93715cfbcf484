"""Operators for building training corpora: ten operators, one module each, and their registered queries."""
