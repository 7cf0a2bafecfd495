"""Relational operators over label evidence, cells, graphs and samples."""
