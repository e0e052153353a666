"""Readers and writers for labelled sequences, model steps, models and reports."""
