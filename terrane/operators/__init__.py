"""Operators on graphs and fields; each is a plan over vertices, edges and basin tables."""
