"""Whole query plans: panel building, the wide table, preprocessing, training, evaluation."""
