"""Operators for training-data pipelines: formatting, extraction, language, dedup, decontamination, packing."""
