"""Readers, writers, the shared test tables and views, and the model registry."""
