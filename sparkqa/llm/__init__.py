"""Operations for building language-model training data, one module per operator."""
