"""Embedding: clean texts, run a model over them in batches, check the result."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.functions.hashing import DEFAULT_DIMS, hashed_model
from chunkwell.functions.text import is_blank, strip

# The length :func:`clean_texts` cuts a text to, and the number of
# texts in one call of the model.
MAX_MODEL_CHARS = 8000
BATCH_SIZE = 100

Model = Callable[[Sequence[str]], Sequence]

#: Why a row has no vector that can be searched, and how much of an exception is kept.
NO_VECTOR, NOT_USABLE, CAUSE_CHARS = "no embedding", "zero or not finite", 500


def cleaned(text: Column, max_chars: int | None = None) -> Column:
    """What a model gets to see: stripped, and NULL if nothing is left; cut only if asked."""
    whole = strip(text)
    return F.when(~is_blank(text), whole if max_chars is None else F.left(whole, F.lit(max_chars)))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not NULL or empty, all finite, not all zero."""
    sound = F.forall(vector, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & sound & F.exists(vector, lambda v: v != 0), F.lit(False))


def clean_texts(
    df: DataFrame, text_col: str = "content", max_chars: int = MAX_MODEL_CHARS
) -> DataFrame:
    """Strip texts, drop blank ones and cut the rest to the model's length."""
    return df.where(~is_blank(F.col(text_col))).withColumn(
        text_col, cleaned(F.col(text_col), max_chars)
    )


def _vectors(values: list) -> pa.Array:
    """Model output as Arrow lists, without a Python object per number."""
    sizes = [0 if v is None else len(v) for v in values]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    present = [np.asarray(v, dtype=np.float32) for v in values if v is not None]
    flat = np.concatenate(present) if present else np.empty(0, np.float32)
    missing = pa.array([v is None for v in values], pa.bool_())
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(flat, pa.float32()), mask=missing
    )


def _run_batches(
    batches: Iterator[pa.Array],
    load: Callable[[], Model],
    batch_size: int,
    pack: Callable[[list], pa.Array],
) -> Iterator[pa.Array]:
    """Feed non-NULL texts to the model in calls of at most ``batch_size``.

    The model is loaded once per task. Results go back to the rows they came
    from, so a text that is left out cannot shift its neighbours.
    """
    model = load()
    for batch in batches:
        texts = batch.to_pylist()
        rows = [i for i, t in enumerate(texts) if t is not None]
        results: list = [None] * len(texts)
        for at in range(0, len(rows), batch_size):
            part = rows[at : at + batch_size]
            answers = list(model([texts[i] for i in part]))
            if len(answers) != len(part):
                raise ValueError(
                    f"the model returned {len(answers)} results for {len(part)} texts"
                )
            for i, answer in zip(part, answers):
                results[i] = answer
        yield pack(results)


def _causes(
    batches: Iterator[pa.Array], load: Callable[[], Model], batch_size: int
) -> Iterator[pa.Array]:
    """As :func:`_run_batches`, for a model that may fail: vectors with the cause of those missing.

    A call that fails is repeated text by text, so that only texts the model cannot take
    are without a vector.
    """

    def call(model: Model, texts: list[str]) -> list[tuple]:
        try:
            answers = list(model(texts))
            if len(answers) != len(texts):
                raise ValueError(f"the model returned {len(answers)} results for {len(texts)} texts")
            return [(a, None) for a in answers]
        except Exception as error:  # noqa: BLE001 - becomes the row's cause
            if len(texts) > 1:
                return [call(model, [t])[0] for t in texts]
            return [(None, f"{type(error).__name__}: {error}"[:CAUSE_CHARS])]

    def pack(answers: list) -> pa.Array:
        pairs = [a if a is not None else (None, None) for a in answers]
        vectors = _vectors([v for v, _ in pairs])
        return pa.StructArray.from_arrays([vectors, pa.array([c for _, c in pairs], pa.string())], ["vector", "cause"])

    model = load()
    yield from _run_batches(batches, lambda: lambda texts: call(model, texts), batch_size, pack)


def _loader(fn: Model | None, factory: Callable[[], Model] | None) -> Callable[[], Model]:
    if (fn is None) == (factory is None):
        raise ValueError("give either fn or factory")
    return factory if factory is not None else (lambda: fn)


def _check_batch_size(batch_size: int) -> None:
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")


def embed_texts(
    df: DataFrame,
    fn: Model | None = None,
    text_col: str = "content",
    batch_size: int = BATCH_SIZE,
    *,
    factory: Callable[[], Model] | None = None,
    embedding_col: str = "embedding",
    keep_blank: bool = False,
    max_chars: int | None = None,
    error_col: str | None = None,
) -> DataFrame:
    """Add one vector per row: ``fn(list of texts) -> list of vectors``.

    The model sees whole texts; a model with a limit of its own names ``max_chars``.

    Give a ``factory`` instead of ``fn`` for a model that is costly to load; it
    is called once per task. Only the text column crosses into Python. Blank
    texts never reach the model; they are dropped, or kept with a NULL vector.

    An exception of the model ends the job. With ``error_col`` it ends the row only: that
    column says why a row has no usable vector, and is NULL where it has one.
    """
    _check_batch_size(batch_size)
    load = _loader(fn, factory)
    rows = df if keep_blank else df.where(~is_blank(F.col(text_col)))
    if error_col:
        kind = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("cause", T.StringType())])

        @F.arrow_udf(kind)
        def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from _causes(texts, load, batch_size)

        made = rows.withColumn("_made", judged.asNondeterministic()(cleaned(F.col(text_col), max_chars)))
        vector = F.col("_made.vector")
        cause = F.coalesce("_made.cause", F.when(vector.isNull(), NO_VECTOR).when(~usable(vector), NOT_USABLE))
        keep = [c for c in rows.columns if c not in (embedding_col, error_col)]
        return made.select(*keep, vector.alias(embedding_col), cause.alias(error_col))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _run_batches(texts, load, batch_size, _vectors)

    # once per row, whatever filters follow: a model call is never duplicated
    once = vectors.asNondeterministic()
    return rows.withColumn(embedding_col, once(cleaned(F.col(text_col), max_chars)))


def embed_hashed(
    df: DataFrame,
    dims: int = DEFAULT_DIMS,
    text_col: str = "content",
    embedding_col: str = "embedding",
    keep_blank: bool = False,
    max_chars: int | None = None,
) -> DataFrame:
    """:func:`embed_texts` with the built-in hashing model."""
    return embed_texts(
        df,
        text_col=text_col,
        factory=partial(hashed_model, dims),
        embedding_col=embedding_col,
        keep_blank=keep_blank,
        max_chars=max_chars,
    )


def embed_queries(
    queries: DataFrame,
    fn: Model | None = None,
    text_col: str = "query_text",
    batch_size: int = BATCH_SIZE,
    *,
    factory: Callable[[], Model] | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """One vector per query; a blank query gets an empty vector."""
    embedded = embed_texts(
        queries, fn, text_col, batch_size, factory=factory, keep_blank=True, max_chars=max_chars
    )
    return embedded.withColumn(
        "embedding",
        F.when(is_blank(F.col(text_col)), F.array().cast("array<float>")).otherwise(
            F.col("embedding")
        ),
    )


def validate_embeddings(
    chunks: DataFrame,
    embeddings: DataFrame,
    key: str = "chunk_id",
    dims: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Chunks without a usable vector: ``(key, problem)``, empty if all is well.

    A vector is missing if its row is absent or NULL, wrong if its width is not
    ``dims``, and without direction if it is zero or not finite. With ``strict``
    the first bad row ends any action on the result with an error.
    """
    known = embeddings.where(F.col("embedding").isNotNull()).select(
        key, F.size("embedding").alias("_width"), usable(F.col("embedding")).alias("_usable")
    )
    fits = F.col("_width") == dims if dims is not None else F.col("_width") > 0
    good, wrong = known.where(fits & F.col("_usable")), known.where(~fits)
    flat = known.where(fits & ~F.col("_usable"))
    # one pass over both sides: left join once, judge by what was found
    best = (
        good.select(key, F.lit(3).alias("_state"))
        .unionByName(flat.select(key, F.lit(2).alias("_state")))
        .unionByName(wrong.select(key, F.lit(1).alias("_state")))
        .groupBy(key)
        .agg(F.max("_state").alias("_state"))
    )
    problems = (
        chunks.select(key)
        .join(best, key, "left")
        .where(F.coalesce("_state", F.lit(0)) < 3)
        .select(
            key,
            F.when(F.col("_state") == 2, "zero or not finite")
            .when(F.col("_state") == 1, "wrong width")
            .otherwise("no embedding")
            .alias("problem"),
        )
    )
    if not strict:
        return problems
    failing = F.concat(F.lit("embedding check failed: "), F.col("problem"))
    # in a condition, which no action can leave out
    return problems.where(F.raise_error(failing).cast("string").isNotNull())
