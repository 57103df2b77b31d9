"""Column functions: text folding, similarity, partial dates, IRIs."""
