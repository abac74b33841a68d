"""Readers, writers, declared schemas and log normalisation."""
