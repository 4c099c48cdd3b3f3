"""Operators on texts in tokens of a public tokenizer: encoding, mixing by source, cutting into pieces."""
