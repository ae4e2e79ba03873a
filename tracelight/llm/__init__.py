"""Operators of a training-data pipeline: quality, packing, deduplication, language, mixing, media, archives, token counts."""
