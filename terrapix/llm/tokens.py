"""Where the vocabularies of public tokenizers lie; they are never copied."""

from __future__ import annotations


def public_byte_bpe(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path of the vocabulary as ranks, which is that of ``byte_bpe_50k.json``, and its splitting pattern."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def public_piece_bpe(name: str = "piece_bpe_32k.model") -> str:
    """Path of the sentencepiece model."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
