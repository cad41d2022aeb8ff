"""Column expressions: cleaning, masking, classification, formatting, time windows."""
