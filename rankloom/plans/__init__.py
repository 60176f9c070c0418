"""Whole jobs: preparation, features, fold training and ranked output."""
