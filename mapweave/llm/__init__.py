"""Operations for corpora of training data."""
