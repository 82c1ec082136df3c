"""Wire formats of graphs and reports."""
