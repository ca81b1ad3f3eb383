"""Training-data operators over document, page, vector and conversation tables."""
