"""Corpus operators for training data: scoring, de-duplication, decontamination and packing."""
