"""Table-level jobs: DataFrame in, DataFrame out."""
