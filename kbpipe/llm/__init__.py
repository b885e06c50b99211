"""Training-data operators over large text tables (see README, "Training data")."""
