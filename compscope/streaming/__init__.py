"""Scoring of arriving compounds with a saved model."""
