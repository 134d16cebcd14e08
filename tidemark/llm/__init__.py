"""Operations of a training-data pipeline: deduplication, search, tokens, language, quality, archives."""
