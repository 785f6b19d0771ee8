"""Statement formats, invoice lists and the synthetic generator."""
