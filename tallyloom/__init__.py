"""Consensus ranking and corpus preparation as DataFrame programs."""
