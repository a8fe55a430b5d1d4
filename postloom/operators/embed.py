"""Texts as vectors: a boundary for any model, and a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import tokenize


def embed(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text") -> DataFrame:
    """Adds `embedding`. `load` gives the model; it runs once in each task, and the model sees whole batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for p in parts:
            model = model or load()
            yield p.assign(embedding=model([t or "" for t in p[text]]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, embedding array<double>")


def hashed(rows: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """Adds `embedding`: term frequencies in `size` places (256 at most), scaled to length 1 (all zeros for no words). A token's place is the first byte of its MD5 sum, modulo `size`. Nothing is fitted."""
    from pyspark.ml.feature import CountVectorizerModel, Normalizer
    from pyspark.ml.functions import vector_to_array

    place = F.create_map(*[x for b in range(256) for x in (F.lit(f"{b:02x}"), F.lit(str(b % size)))])
    words = rows.withColumn("_places", F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda t: F.element_at(place, F.substring(F.md5(t.cast("binary")), 1, 2))))
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(size)], "_places", "_tf")
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counter.transform(words))
    return unit.withColumn("embedding", vector_to_array("_unit")).select(*rows.columns, "embedding")
