"""Reading, writing, previews and synthetic tables."""
