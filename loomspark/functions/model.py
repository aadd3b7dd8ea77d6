"""Sizes of transformer models from their configurations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parameters(hidden: Column, layers: Column, heads: Column, kv_heads: Column, head_dim: Column, intermediate: Column, vocabulary: Column, tied: Column) -> Column:
    """Weights of all layers (four attention matrices, three of a gated feed-forward, two norms), the last norm, and the embedding, once if the output shares it."""
    hidden, layers = hidden.cast("long"), layers.cast("long")
    attention = 2 * hidden * head_dim * (heads + kv_heads)
    layer = attention + 3 * hidden * intermediate + 2 * hidden
    return layers * layer + hidden + vocabulary * hidden * F.when(tied, 1).otherwise(2)


def cache_bytes(layers: Column, kv_heads: Column, head_dim: Column, width: int = 4) -> Column:
    """Bytes of keys and values that one token keeps, `width` a number."""
    return 2 * width * layers.cast("long") * kv_heads * head_dim
