"""Entity mentions: extraction, best predictions, thresholds and resolution."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import settings
from newsloom.functions import identity, text
from newsloom.operators import catalog as catalogs
from newsloom.operators import matching, phrases
from newsloom.session import spread

# One text in, spans out: (text, label, score, start, end).
Span = tuple[str, str, float, int, int]
EntityExtractor = Callable[[str], list[Span]]

CHUNKS = "chunk INT, chunk_start INT, chunk_end INT"
SPANS = "label STRING, text STRING, score DOUBLE, start INT, end INT"


def keyed_schema(df: DataFrame, columns: str) -> str:
    """Schema of rows keyed by the ``id`` of ``df``."""
    return f"id {df.schema['id'].dataType.simpleString()}, {columns}"

_NON_SPACE = re.compile(r"\S+")


def chunk_bounds(value: str, max_words: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks: chunk ``i`` holds up to ``max_words`` words from word ``i * step`` on.

    ``step`` is ``max_words - overlap``; the first chunk that reaches the last word is the last.
    """
    starts, ends = [], []
    for word in _NON_SPACE.finditer(value):
        starts.append(word.start())
        ends.append(word.end())
    step = max_words - overlap
    beyond = max(0, len(starts) - max_words)
    chunks = 1 + -(-beyond // step) if starts else 0
    return [(starts[i * step], ends[i * step : i * step + max_words][-1]) for i in range(chunks)]


def _check_chunking(max_words: int, overlap: int) -> None:
    if max_words < 1 or overlap < 0 or overlap >= max_words:
        raise ValueError("chunk word limits are invalid")


def _column_batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def word_chunks(
    articles: DataFrame,
    *,
    text_column: str = "content",
    max_words: int = settings.CHUNK_WORDS,
    overlap: int = settings.CHUNK_OVERLAP,
    keep_text: bool = True,
) -> DataFrame:
    """Overlapping word chunks of whole texts with character offsets."""
    _check_chunking(max_words, overlap)
    schema = keyed_schema(articles, CHUNKS + (", chunk_text STRING" if keep_text else ""))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            fields = [("id", keys.type), ("chunk", pa.int32()), ("chunk_start", pa.int32()),
                      ("chunk_end", pa.int32())]
            if keep_text:
                fields.append(("chunk_text", pa.string()))
            columns: list[list] = [[] for _ in fields]
            for key, value in zip(keys.to_pylist(), batch.column(1).to_pylist(), strict=True):
                for number, (start, end) in enumerate(chunk_bounds(value or "", max_words, overlap)):
                    row = (key, number, start, end, (value or "")[start:end])
                    for column, cell in zip(columns, row, strict=False):
                        column.append(cell)
            yield _column_batch(pa.schema(fields), columns)

    return spread(articles.select("id", text_column)).mapInArrow(split, schema)


def chunk_limit_problem(
    words: Column,
    characters: Column,
    *,
    max_words: int = settings.CHUNK_WORDS,
    overlap: int = settings.CHUNK_OVERLAP,
    max_chunks: int = settings.CHUNK_LIMIT,
    max_chars: int = settings.CHUNK_MAX_CHARS,
) -> Column:
    """Which chunking limit a text breaks, for callers that enforce limits."""
    step = max_words - overlap
    chunks = F.greatest(F.lit(1), F.ceil((words - overlap) / step))
    return F.when(characters > max_chars, "text_length").when(
        chunks > max_chunks, "chunk_count"
    )


def catalog_extractor(rules: list[tuple[str, str]]) -> EntityExtractor:
    """Extractor of (alias, label) rules: whole words, any case, score 1."""
    distinct = {(matching.fold(alias), label): (alias, label) for alias, label in rules}
    kept = list(distinct.values())
    index = matching.PhraseIndex(alias for alias, _ in kept)
    labels = [label for _, label in kept]

    def extract(value: str) -> list[Span]:
        return [
            (value[start:end], labels[number], 1.0, start, end)
            for start, end, number in matching.spans(value, index)
        ]

    return extract


def catalog_spans(
    articles: DataFrame, rules: DataFrame, *, text_column: str = "filtered_content", overlapping: bool = False
) -> DataFrame:
    """The spans of a catalog of any size: rows as :func:`extract_spans` gives them, score 1.

    ``rules``: alias and label. Spans of one alias don't overlap each other unless ``overlapping``;
    those of different aliases, such as a name inside a longer one, all count. A text is read once
    and its spans leave with their own text, so neither texts nor spans are gathered by article.
    """
    known = phrases.dictionary(rules.select("alias", "label")).select("folded", "first", "tokens", "label").distinct()
    found = phrases.find(articles, known, text_column=text_column, overlapping=overlapping, pieces=True)
    placed = found.select("id", "label", F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("pieces").alias("text"))))
    return _with_forms(
        placed.select(
            "id", "label", "text", F.lit(1.0).alias("score"), "start", (F.col("start") + F.length("text")).alias("end")
        )
    )


def catalog_mentions(
    articles: DataFrame, rules: DataFrame, entities: DataFrame, *, text_column: str = "filtered_content", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The spans of :func:`catalog_spans` with their entities, a row per id: ``id``, ``keep``, ``texts``, ``found``.

    ``found`` has a row (label, text, starts, score, canonical_entity_id, canonical_name) per label and
    written form, which :func:`placed` spreads to spans; ``texts`` counts the texts that aren't null.
    Articles of one id must come together, with the same ``keep``. A form is resolved once for its places
    in a text, and rows leave their partition only where the catalog is too large to broadcast.
    """
    known = phrases.dictionary(rules.select("alias", "label")).select("folded", "first", "tokens", "label").distinct()
    filters = phrases.Filters.of(known)
    texts = articles.select("id", *keep, F.col(text_column).isNotNull().alias("has_text"), text_column)
    marked = phrases.marked(texts, filters, text_column=text_column, keep=(*keep, "has_text"), overlapping=False)
    formed = _with_forms(marked.withColumnRenamed("form", "text").withColumn("score", F.lit(1.0)))
    rows = phrases.met(formed, known.select("folded", "label"), filters)
    columns = ["label", "text", "starts", "score", "canonical_entity_id", "canonical_name"]
    resolved = persistable(resolve(rows, entities, ordered=True)).select("id", *keep, "has_text", "_article", *columns)
    kept = ("id", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, heads, begins in phrases.whole(batches, by_id=True):
            own = np.zeros(batch.num_rows, dtype=bool)
            own[heads] = True
            found = batch.select(columns).filter(pa.array(~own))
            ahead = np.concatenate((np.cumsum(~own) - ~own, [found.num_rows]))  # runs before a row
            held = batch.column("has_text").to_numpy(zero_copy_only=False)[heads].astype(np.int32)
            groups = pa.ListArray.from_arrays(pa.array(ahead[[*begins, -1]], pa.int32()), found.to_struct_array())
            number = pa.array(np.add.reduceat(held, np.searchsorted(heads, begins)), pa.int32())
            first = batch.take(pa.array(begins))
            yield pa.RecordBatch.from_arrays([*(first.column(c) for c in kept), number, groups], names=[*kept, "texts", "found"])

    form = T.StructType([resolved.schema[c] for c in columns])
    fields = [*(resolved.schema[c] for c in kept), T.StructField("texts", T.IntegerType()), T.StructField("found", T.ArrayType(form))]
    return resolved.mapInArrow(run, T.StructType(fields))


def placed(found: Column) -> Column:
    """The spans of ``found`` of :func:`catalog_mentions`, in order."""

    def spans(form: Column) -> Column:
        others = [form[c].alias(c) for c in ("label", "text", "score", "canonical_entity_id", "canonical_name")]
        return F.transform(
            form["starts"], lambda start: F.struct(start.alias("start"), (start + F.length(form["text"])).alias("end"), *others)
        )

    return F.array_sort(F.flatten(F.transform(found, spans)))


def _with_forms(spans: DataFrame) -> DataFrame:
    """Spans with the name key and slug of their text, which resolution needs: for most words just their lower case."""
    word, plain = F.col("text").rlike("^[A-Za-z0-9]+$"), F.lower("text")
    return spans.withColumns(
        {
            "name_key": F.when(word, plain).otherwise(text.name_key(F.col("text"))),
            "slug": F.when(word, plain).otherwise(text.slugify(F.col("text"))),
        }
    )


def literal_extractor(rules: list[tuple[str, str, float]]) -> EntityExtractor:
    """Extractor of (text, label, score) rules: exact case, inside words too."""

    def extract(value: str) -> list[Span]:
        return [
            (m.group(), label, score, m.start(), m.end())
            for literal, label, score in rules
            for m in re.finditer(re.escape(literal), value)
        ]

    return extract


def extract_spans(
    articles: DataFrame,
    extractor: EntityExtractor,
    *,
    text_column: str = "filtered_content",
    threshold: float = settings.MODEL_THRESHOLD,
    labels: tuple[str, ...] = settings.ENTITY_TYPES,
    max_words: int = settings.CHUNK_WORDS,
    overlap: int = settings.CHUNK_OVERLAP,
) -> DataFrame:
    """One row per distinct (label, start, end) of each article, best score first.

    The extractor sees one chunk at a time; offsets are shifted to the article.
    An article is one row, so the best of its overlapping chunks is chosen right
    there and no shuffle is needed.
    """
    _check_chunking(max_words, overlap)
    schema = keyed_schema(articles, SPANS)
    wanted = frozenset(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            out = pa.schema(
                [("id", keys.type), ("label", pa.string()), ("text", pa.string()),
                 ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]
            )
            for key, value in zip(keys.to_pylist(), batch.column(1).to_pylist(), strict=True):
                best: dict[tuple[str, int, int], tuple[str, float]] = {}
                for at, stop in chunk_bounds(value or "", max_words, overlap):
                    for piece, label, score, start, end in extractor(value[at:stop]):
                        if score < threshold or label not in wanted:
                            continue
                        span = (label, at + start, at + end)
                        known = best.get(span)
                        if known is None or score > known[1]:
                            best[span] = (piece, score)
                if not best:
                    continue
                yield _column_batch(
                    out,
                    [[key] * len(best), [k[0] for k in best], [piece for piece, _ in best.values()],
                     [score for _, score in best.values()], [k[1] for k in best], [k[2] for k in best]],
                )

    return _with_forms(spread(articles.select("id", text_column)).mapInArrow(run, schema))


def best_predictions(spans: DataFrame, *, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Best score per (article, label, start, end); the earliest wins a tie.

    For span tables with an ``ordinal``; the top-1 runs before the shuffle too.
    """
    window = Window.partitionBy(*keys, "label", "start", "end").orderBy(
        F.col("score").desc(), F.col("ordinal")
    )
    return spans.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def span_problem(source: Column) -> Column:
    """First broken rule of a span row (label, text, score, start, end)."""
    start, end, score = F.col("start"), F.col("end"), F.col("score")
    found = F.substr(source, start + 1, end - start)
    return (
        F.when(F.isnull("text") | start.isNull() | end.isNull() | score.isNull(), "missing_field")
        .when(text.entity_label(F.col("label")).isNull(), "unknown_label")
        .when((start < 0) | (end <= start) | (end > F.length(source)), "offsets_outside")
        .when(found != F.col("text"), "text_mismatch")
        .when(text.strip(found) == "", "blank_text")
        .when(~score.between(0, 1), "score_outside")
    )


def persistable(spans: DataFrame, minimum: float = settings.PERSIST_THRESHOLD) -> DataFrame:
    return spans.filter(F.col("score") >= minimum)


def resolve(spans: DataFrame, entities: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Add ``canonical_entity_id`` and ``canonical_name``.

    By (label, name), else by name in any type, else a deterministic id of the
    mention itself. The lookup joins are plain equi-joins: Spark broadcasts the
    catalog while its size allows and splits skewed names otherwise. Spans that
    do not carry ``name_key`` and ``slug`` get them here. ``ordered``: rows of
    :func:`phrases.marked`, which stay in their order.
    """
    by_label, by_any = catalogs.lookup(entities)
    if ordered:
        size = by_label.agg(F.sum(phrases.weight("label", "name_key", "id", "canonical_name"))).first()[0] or 0
        held = size <= phrases.BROADCAST_BYTES
        by_label, by_any = (F.broadcast(by_label), F.broadcast(by_any)) if held else (by_label, by_any)
    own_name = text.strip(F.col("text"))
    columns = [c for c in spans.columns if c not in ("name_key", "slug")]
    keyed = spans.withColumn("label", F.upper("label"))
    if "name_key" not in spans.columns:
        keyed = keyed.withColumn("name_key", text.name_key(F.col("text")))
    if "slug" not in spans.columns:
        keyed = keyed.withColumn("slug", text.slugify(own_name))
    joined = keyed.join(
        by_label.select(
            "label", "name_key", F.struct("id", "canonical_name").alias("_typed")
        ),
        ["label", "name_key"],
        "left",
    ).join(
        by_any.select("name_key", F.struct("id", "canonical_name").alias("_any")),
        "name_key",
        "left",
    )
    own_id = identity.entity_id(F.concat(F.col("label"), F.lit(":"), F.col("slug")))
    found = F.coalesce("_typed", "_any")
    joined = phrases.in_order(joined, held) if ordered else joined
    return joined.select(
        *columns,
        F.coalesce(found["id"], own_id).alias("canonical_entity_id"),
        F.coalesce(found["canonical_name"], own_name).alias("canonical_name"),
    )


def named(mentions: DataFrame) -> DataFrame:
    """(article, entity key) of mentions that carry an id and a name."""
    return mentions.filter(
        (F.coalesce("canonical_entity_id", F.lit("")) != "")
        & (F.coalesce("canonical_name", F.lit("")) != "")
    ).select(
        "article_id",
        F.col("canonical_entity_id").alias("entity_id"),
        "canonical_name",
        F.upper(F.coalesce("label", F.lit("CLUB"))).alias("entity_type"),
    )


def flatten(news_entities: DataFrame) -> DataFrame:
    """The mentions fact: one row per element of ``news_entities.entities``."""
    return news_entities.select(F.col("id").alias("article_id"), F.inline("entities"))


def article_tallies(spans: DataFrame, minimum: float = settings.PERSIST_THRESHOLD) -> DataFrame:
    """Raw, persisted and low-score span counts per article."""
    kept = F.col("score") >= minimum
    return spans.groupBy("id").agg(
        F.count("*").alias("raw_entities"),
        F.count_if(kept).alias("persisted_entities"),
        F.count_if(~kept).alias("skipped_low_score"),
    )
