"""Operations for large-scale training-data pipelines; one module for each operator."""
