"""Whole plans: from signals to fingerprints, from fingerprints to answers."""
