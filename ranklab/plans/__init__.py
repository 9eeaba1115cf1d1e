"""Contracts, the transform / bundle / evaluate drivers, sweeps, and the registered checks."""
