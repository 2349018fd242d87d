"""Rankers: gradient-boosted trees on pairwise gradients, and a neural news encoder's inference."""
