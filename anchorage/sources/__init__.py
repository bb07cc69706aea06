"""Strict readers of sequence resources."""
