"""Analytics on dynamic graphs, from the operators."""
