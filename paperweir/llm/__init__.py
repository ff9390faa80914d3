"""Operators for texts of training data. Nothing outside this subpackage imports it."""
