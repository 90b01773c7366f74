"""DataFrame-to-DataFrame stages of the embedding plan."""
