"""Operators for preparing training corpora; nothing else in lamina imports this subpackage."""
