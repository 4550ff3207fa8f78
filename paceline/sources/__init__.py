"""Reading logs and profiles, their dictionaries, and the segment store."""
