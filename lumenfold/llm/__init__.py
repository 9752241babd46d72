"""Operators for preparing language-model training data; nothing else in lumenfold imports this subpackage."""
