"""Scalar expressions: columns in, column out, all inside code generation."""
