"""A watched folder, ingested as its files arrive."""
