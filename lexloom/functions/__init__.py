"""Scalar functions on columns: text normalisation, pair parsing, ids, label parsing, vectors."""
