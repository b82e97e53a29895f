"""Language of texts and pages by fusing evidence in Bayes' rule.

The text gives a likelihood per language, from character trigrams of its words; what is
declared in the markup a second one, by how often pages of each language declare what;
and the address a prior, smoothed from all rows to an address suffix to a host. Priors
and reliabilities are sums of the texts' own posteriors by group, so no row needs a label
but those the trigram model is fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.llm.common import slices, texts_of
from chunkwell.llm.words import mix
from chunkwell.session import written

#: About so many labelled rows of a language at most are fitted on, chosen by a hash of the text.
FIT_ROWS = 5_000
#: Trigram buckets of the model, and languages it can tell apart: it has a bounded size.
BUCKETS, MAX_LANGUAGES = 1 << 15, 200
#: Trigrams overlap and repeat: this many count at most, and each with this share.
MOST_GRAMS, SHARE = 300, 0.3
#: Share of a language's trigrams that are spread over all buckets.
UNSEEN = 0.05
#: Rows that a group's parent counts for, and added counts of each declared language.
PARENT_ROWS, ADDED = 5.0, 0.5
#: The language of texts that none of the known ones explains better than chance.
UNKNOWN, UNKNOWN_PRIOR = "und", 0.001

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_PIECE = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and the log-probability of each trigram bucket, a row per bucket."""

    languages: tuple[str, ...]
    log_share: np.ndarray


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the trigrams of the text's words, marked at both ends, a piece at a time."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words:
        return
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(codes) - 2, _PIECE):
        part = codes[at : at + _PIECE + 2].astype(np.uint64)
        value = (part[:-2] << np.uint64(42)) ^ (part[1:-1] << np.uint64(21)) ^ part[2:]
        yield (mix(value) & np.uint64(BUCKETS - 1)).astype(np.int64)


def fit_languages(labelled: DataFrame, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Fits trigram shares on ``(text, lang)`` rows; rows with a NULL label are left out.

    At most about ``FIT_ROWS`` different texts of each language are used, the documented
    bound of the fit, so neither a frequent language nor a text with many copies takes the
    place of others. The model tells ``max_languages`` apart, the most frequent labels.
    Without rows every text is ``und``.
    """
    hashed = F.xxhash64("text")
    labelled = labelled.where("lang IS NOT NULL").select("text", "lang")
    known = labelled.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n"))
    known = {r.lang: r.n for r in known.orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    languages = tuple(sorted(known))
    least = [(lang, int(min(1.0, FIT_ROWS / max(1, n)) * 1_000_000)) for lang, n in known.items()]
    least = labelled.sparkSession.createDataFrame(least, "lang string, least int")
    chosen = labelled.join(F.broadcast(least), "lang").where(F.pmod(hashed, F.lit(1_000_000)) < F.col("least"))
    chosen = chosen.select("text", "lang").dropDuplicates()

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(BUCKETS, np.int64) for lang in languages}
        for batch in slices(stream):
            for text, lang in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for part in trigrams(text) if lang in sums else ():
                    sums[lang] += np.bincount(part, minlength=BUCKETS)
        for lang, n in sums.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(full), pa.array(n[full])],
                names=["lang", "bucket", "n"],
            )

    counts = chosen.mapInArrow(count, "lang string, bucket bigint, n bigint")
    table = np.zeros((len(languages), BUCKETS))
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    rows = pc.index_in(found["lang"], value_set=pa.array(languages, pa.string())).to_numpy()
    table[rows.astype(np.int64), found["bucket"].to_numpy()] = found["n"].to_numpy()
    # a trigram that was never seen has a share all the same
    seen = table.sum(axis=1, keepdims=True)
    table = (1 - UNSEEN) * table / np.maximum(seen, 1) + UNSEEN / BUCKETS
    return LanguageModel(languages, np.ascontiguousarray(np.log(table).T.astype(np.float32)))


def text_evidence(model: LanguageModel, text: str) -> tuple[int, list[float]]:
    """Trigrams of the text, and its log-likelihood per language and for ``und``."""
    total, n = np.zeros(len(model.languages)), 0
    for part in trigrams(text):
        counts = np.bincount(part, minlength=BUCKETS) if len(part) > BUCKETS else None
        if counts is None:
            total += model.log_share[part].sum(axis=0, dtype=np.float64)
        else:
            total += counts @ model.log_share.astype(np.float64)
        n += len(part)
    if not n:
        return 0, [0.0] * (len(model.languages) + 1)
    weight = SHARE * min(n, MOST_GRAMS)
    return n, [*(weight * total / n), -weight * float(np.log(BUCKETS))]


def _softmax(scores: list[float]) -> list[float]:
    e = np.exp(np.array(scores) - max(scores))
    return list(e / e.sum())


def identify(rows: DataFrame, model: LanguageModel, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """All columns but the text, with ``language``, ``confidence``, ``text_language`` and ``accepted``.

    ``rows`` have ``host``, ``suffix`` and ``declared`` (strings, NULL for no evidence) and
    the text; any further columns pass through. Only the names of the result's own four
    columns are taken, and an input column of such a name is an error. A row is accepted if its language is a known one with confidence ``least`` or
    more. A NULL or empty text, or one without letters, has no language and is not
    accepted, whatever is declared. Repeated rows stay repeated rows.

    A row's own posterior is taken out of the sums it is judged by. Sums are combined
    before the shuffle; the joins with them are splittable, so a host that holds a third
    of the rows makes no long task. Texts are read once; what moves is a row of numbers.
    """
    names = (*model.languages, UNKNOWN)
    size = len(names)
    kept = [c for c in rows.columns if c != text]
    if taken := {"language", "confidence", "text_language", "accepted"} & set(kept):
        raise ValueError(f"columns of the result are there already: {sorted(taken)}")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            found = [text_evidence(model, t) for t in texts_of(batch.column(4))]
            posterior = [_softmax(e) if n else [0.0] * size for n, e in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([e for _, e in found], pa.list_(pa.float64())),
                    pa.array(posterior, pa.list_(pa.float64())),
                ],
                names=fields.names,
            )

    # the given columns travel in one, so no name of theirs can meet one of these
    given = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("given")
    made = rows.select(given, "host", "suffix", "declared", F.col(f"`{text}`").alias("text"))
    added = T.StructType.fromDDL("n_grams bigint, e array<double>, p array<double>")
    fields = T.StructType(made.drop("text").schema.fields + added.fields)
    scored = written(made.mapInArrow(run, fields))

    def sums(by: str, name: str) -> DataFrame:
        one = F.array(*[F.sum(F.col("p")[k]) for k in range(size)])
        return scored.where(F.col(by).isNotNull()).groupBy(by).agg(one.alias(name))

    whole = scored.agg(F.array(*[F.coalesce(F.sum(F.col("p")[k]), F.lit(0.0)) for k in range(size)])).head()[0]
    prior = [(w + 1) / (sum(whole) + size) for w in whole]
    prior[-1] = min(prior[-1], UNKNOWN_PRIOR)
    zeros = F.array(*[F.lit(0.0)] * size)
    joined = scored
    for by, name in (("suffix", "s"), ("host", "h"), ("declared", "d")):
        joined = joined.join(sums(by, name), by, "left").withColumn(name, F.coalesce(name, zeros))
    different = max(1, scored.select("declared").distinct().count())

    def smoothed(counts: str, parent: list[Column]) -> list[Column]:
        # without evidence the counts are 0 and the parent stands
        own = [F.greatest(F.col(counts)[k] - F.col("p")[k], F.lit(0.0)) for k in range(size)]
        total = sum(own[1:], own[0]) + PARENT_ROWS
        return [(own[k] + PARENT_ROWS * parent[k]) / total for k in range(size)]

    by_host = smoothed("h", smoothed("s", [F.lit(p) for p in prior]))
    declared = [
        F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(
            F.log(
                (F.greatest(F.col("d")[k] - F.col("p")[k], F.lit(0.0)) + ADDED)
                / (F.greatest(F.lit(whole[k]) - F.col("p")[k], F.lit(0.0)) + ADDED * different)
            )
        )
        for k in range(size - 1)
    ]
    # an unknown language says nothing about what is declared
    declared.append(F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.lit(-float(np.log(different)))))
    scores = F.array(*[F.col("e")[k] + F.log(by_host[k]) + declared[k] for k in range(size)])
    labels = F.array(*map(F.lit, names))
    best = F.array_position("f", F.array_max("f")).cast("int")
    share = 1 / F.aggregate(F.transform("f", lambda x: F.exp(x - F.array_max("f"))), F.lit(0.0), lambda a, x: a + x)
    fused = joined.withColumn("f", scores)
    language = F.when(F.col("n_grams") > 0, F.element_at(labels, best))
    read = F.element_at(labels, F.array_position("p", F.array_max("p")).cast("int"))
    fused = fused.select(
        "given",
        language.alias("language"),
        F.when(F.col("n_grams") > 0, share).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("n_grams") > 0, read).alias("text_language"),
    )
    fine = F.coalesce((F.col("language") != UNKNOWN) & (F.col("confidence") >= least), F.lit(False))
    fused = fused.withColumn("accepted", fine)
    return fused.select("given.*", "language", "confidence", "text_language", "accepted")


def declared_language(html: Column) -> Column:
    """The primary language subtag that the ``html`` tag declares; NULL without one."""
    tag = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def markup_text(html: Column) -> Column:
    """The text of a page without comments, scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def address_suffix(host: Column) -> Column:
    """The last label of a host; NULL without one."""
    return F.nullif(F.regexp_extract(host, r"([^.]*)$", 1), F.lit(""))
