"""Operations of a training-data pipeline: ten operators on whole corpora of text, pages and token ids."""
