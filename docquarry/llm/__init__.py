"""Operators for building language-model training corpora; nothing outside this subpackage imports it."""
