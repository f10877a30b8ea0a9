"""lakevec: vector search, vector indexes and their upkeep as Spark jobs."""
