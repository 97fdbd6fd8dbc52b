"""Whole protocols: preparation, benchmark build, fitting and evaluation."""
