"""Column expressions for text cleaning, fact extraction and vectors."""
