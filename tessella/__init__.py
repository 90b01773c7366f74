"""Tessella: neighbour embedding and related data operators as Spark plans."""
