"""Training-data operators: one module each, plus their registered queries."""
