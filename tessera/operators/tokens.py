"""P12 with a caller tokenizer, A5 per document.

The built-in modes are JVM expressions (:func:`tessera.functions.text.token_count`).  A
caller tokenizer (BPE, sentencepiece, ...) runs as an Arrow-batched pandas UDF, built once
per Python worker from a factory.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship_package

_CACHE: dict[object, Callable] = {}


def count_tokens_with(text, factory: Callable[[], Callable[[str], int]]) -> Column:
    """Tokens per text from ``factory()`` (a ``str -> int`` counter); null text counts 0."""
    key = getattr(factory, "cache_key", None) or id(factory)
    ship_package()

    @F.pandas_udf("long")
    def _count(s: pd.Series) -> pd.Series:
        fn = _CACHE.get(key)
        if fn is None:
            fn = _CACHE[key] = factory()
        return s.map(lambda t: int(fn(t)) if t is not None else 0).astype("int64")

    return _count(F.col(text) if isinstance(text, str) else text)
