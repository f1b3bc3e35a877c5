"""Batch operators. Most of them also accept a streaming DataFrame; those that do not say so."""
