"""Compositions of operators: reports, voyage prediction, customer messages."""
