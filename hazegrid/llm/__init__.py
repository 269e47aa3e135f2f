"""Operators that prepare text for language-model training, each over whole tables."""
