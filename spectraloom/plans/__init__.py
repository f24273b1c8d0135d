"""Queries wired from the operators, each with its SQL oracle."""
