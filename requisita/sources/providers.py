"""Recognition and outside models are given as plain functions.

``recognise(content, dpi)`` returns tokens as dictionaries; ``ask(prompt, image)``
returns text.  They run on executors, a file at a time; an error becomes the
file's ``error`` and never fails the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = "archivo string, dpi int, tok_seq long, text string, conf int, x int, y int, x2 int, y2 int, cx double, cy double, error string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
_TOKEN_SCHEMA = [(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in TOKENS.split(", "))]
#: Files a batch, so that few images are in memory at a time.
FILES_A_BATCH = 8


def recognise_files(files: DataFrame, recognise: Callable[[bytes, int], list[dict]], dpis=(300, 400)) -> DataFrame:
    """Tokens of each file (archivo, content) at each resolution."""
    columns = _TOKEN_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = {"archivo": row["archivo"], "dpi": row["dpi"]}
                try:
                    found = recognise(bytes(row["content"]), row["dpi"])
                    rows = [own | {"tok_seq": i, **t, "cx": (t["x"] + t["x2"]) / 2, "cy": (t["y"] + t["y2"]) / 2} for i, t in enumerate(found)]
                    rows = rows or [own | {"error": "OCR sin resultados"}]
                except Exception as e:  # noqa: BLE001  the file's error, not the job's
                    rows = [own | {"error": str(e) or type(e).__name__}]
                yield pa.RecordBatch.from_pylist([{name: r.get(name) for name, _ in columns} for r in rows], schema=pa.schema(columns))

    # only ever lowered, so that no plan gets larger batches than it asked for
    conf, key = files.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(conf.get(key, "10000"))
    if have <= 0 or have > FILES_A_BATCH:
        conf.set(key, str(FILES_A_BATCH))
    each = files.select("archivo", "content", F.explode(F.array(*map(F.lit, dpis))).alias("dpi"))
    return each.mapInArrow(run, TOKENS)


def ask_model(requests: DataFrame, ask: Callable[[str, bytes | None], str]) -> DataFrame:
    """Adds ``text``, an outside model's reply to each row's (prompt, image), and
    ``status``: ok, or error with null text."""
    schema = T.StructType([*requests.schema.fields, T.StructField("text", T.StringType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, status = [], []
            for prompt, image in zip(batch.column("prompt").to_pylist(), batch.column("image").to_pylist()):
                try:
                    texts.append(ask(prompt, image))
                    status.append("ok")
                except Exception:  # noqa: BLE001
                    texts.append(None)
                    status.append("error")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(status, pa.string())], names=[*batch.schema.names, "text", "status"])

    return requests.mapInArrow(run, schema)


def call_counts(replies: DataFrame) -> DataFrame:
    """One row: calls that went well, and that failed."""
    return replies.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"))


# ---- pixel work for recognisers, on arrays of height x width x 3


def remove_colored_marks(image: np.ndarray) -> np.ndarray:
    """Stamps and pen become white: pixels that are bright or coloured."""
    top, low = image.max(2).astype(int), image.min(2).astype(int)
    saturation = np.where(top > 0, 255 * (top - low) // np.maximum(top, 1), 0)
    out = image.copy()
    out[(top > 170) | (saturation > 40)] = 255
    return out


def binarize(gray: np.ndarray) -> np.ndarray:
    """Black and white, at the level that best separates dark from bright."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    levels = np.arange(256)
    below, total = np.cumsum(counts), counts.sum()
    weight = np.cumsum(counts * levels)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (weight[-1] * below / total - weight) ** 2 / (below * (total - below))
    return np.where(gray > int(np.nan_to_num(spread).argmax()), 255, 0).astype(np.uint8)


def remove_rules(binary: np.ndarray) -> np.ndarray:
    """Without horizontal and vertical lines of a fortieth of the width."""
    size = max(40, binary.shape[1] // 40)

    def runs(dark):  # dark runs of at least ``size`` along the rows
        padded = np.zeros((dark.shape[0], dark.shape[1] + 2), np.int8)
        padded[:, 1:-1] = dark
        step = np.diff(padded, axis=1)
        row, start = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        out = np.zeros_like(dark)
        for r, a, b in zip(row, start, end):
            if b - a >= size:
                out[r, a:b] = True
        return out

    dark = binary == 0
    out = binary.copy()
    out[runs(dark) | runs(dark.T).T] = 255
    return out
