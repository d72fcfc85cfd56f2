"""Whole jobs composed from the operators: stages, sweeps, programs."""
