"""Operations of a training-data pipeline: tokens, copies, secrets, quality, packing, pages."""
