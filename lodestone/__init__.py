"""lodestone: retrieval-oriented document analytics as DataFrame and SQL plans."""
