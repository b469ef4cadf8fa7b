"""Training-data operators on whole corpora."""
