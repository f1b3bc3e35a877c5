"""Operations of a training-data pipeline over large collections of documents."""
