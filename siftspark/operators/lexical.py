"""Full-text search: an index of token occurrences, and BM25 over it.

The index is ``postings(term, field, ids, dls, poss)`` and ``lengths(id, dl)``. A task splits its texts in blocks, and a row lists
where a term stands in a field of a block's documents: three arrays of one length. Tasks write what they have listed in order of
the term, without a shuffle, so that a query reads those pages only that can have its terms. Every occurrence has its document's
length, so that scoring joins nothing with the lengths; a row without a term lists the documents of a block.
Terms are kept as they are; a stemmed search has the table ``vocabulary(term, stem)`` beside them, and reads the terms of a
query's stems. Statistics are of the whole index whatever a query filters. ``operators.segments`` keeps an index up to date.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.porter import stem, stem_of
from ..functions.query_terms import QUERY_WORD
from ..functions.text import tokens
from ..sources.tables import local_table, settled

K1, B = 1.2, 0.75
SUBJECT_BOOST = 5.0
#: Occurrences of a block; a longer document is a block of its own.
BLOCK = 1 << 20
#: Phrases of all queries together that are sent to every task; beyond it they are joined by shuffles.
MOST_SENT = 20_000
#: Terms that are named to the scan, for it to skip the pages that cannot have them.
MOST_NAMED = 1_000


@dataclass
class Index:
    """``seg`` numbers the segments of an index that has several; an id of ``dead`` (id, until) is dead in those below ``until``.
    ``stats``: number of rows and of tokens, where they are known without reading ``lengths``."""

    postings: DataFrame  # term, field, ids, dls, poss[, seg]
    lengths: DataFrame  # id, dl
    porter: bool = False  # whether queries are stemmed
    vocabulary: DataFrame | None = None  # term, stem
    dead: DataFrame | None = None
    stats: tuple[int, int] | None = None


def build_index(text: DataFrame, fields: list[str], id_col: str = "id") -> Index:
    """Of the token occurrences of ``fields``."""
    rows = text.select(F.col(id_col).alias("id"), *(tokens(f).alias(f"_{n}") for n, f in enumerate(fields)))
    length = sum((F.size(f"_{n}").cast("long") for n in range(len(fields))), F.lit(0).cast("long"))
    return Index(_split_lists(rows, fields), rows.select("id", length.alias("dl")))


def postings_schema(id_type: str) -> str:
    return f"term string, field string, ids array<{id_type}>, dls array<int>, poss array<int>"


def _split_lists(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The postings of ``rows``: id, and for each field an array of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(pc.list_value_length(c).to_numpy() for c in batch.columns[1:])
            ends = np.cumsum(n)
            # a block ends before the row that would pass the next multiple of its size
            cuts = np.flatnonzero(np.diff(ends // BLOCK)) + 1 if len(ends) else []
            for a, b in zip([0, *cuts], [*cuts, len(ends)]):
                part = batch.slice(a, b - a)
                ids, dl = part.column(0), n[a:b].astype(np.int32)
                terms, doc, pos, field = [], [], [], []
                for f, column in enumerate(part.columns[1:]):
                    size = pc.list_value_length(column).to_numpy()
                    terms.append(column.flatten())
                    doc.append(np.repeat(np.arange(len(size)), size))
                    pos.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                    field.append(np.full(size.sum(), f))
                doc = np.concatenate(doc)
                yield _lists(pa.concat_arrays(terms), np.concatenate(field), pa.array(fields), ids.take(pa.array(doc)), dl[doc], np.concatenate(pos))
                yield _batch(pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), [0, len(ids)], ids, dl, None)

    return rows.mapInArrow(run, postings_schema(rows.schema["id"].dataType.simpleString()))


def listed(occurrences: DataFrame) -> DataFrame:
    """The postings of rows (term, field, id, dl, pos), without those that list documents."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        term, field, ids, dl, pos = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        named = (field.chunk(0) if isinstance(field, pa.ChunkedArray) else field).dictionary_encode()
        return _lists(term, named.indices.to_numpy(), named.dictionary, ids, dl.to_numpy(), pos.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    rows = occurrences.select("term", "field", "id", F.col("dl").cast("int").alias("dl"), "pos")
    return rows.mapInArrow(run, postings_schema(rows.schema["id"].dataType.simpleString()))


def _lists(terms: pa.Array, field: np.ndarray, names: pa.Array, ids: pa.Array, dl: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row for each term and field, of as many arrays as there are occurrences."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64) * len(names) + field
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    term, name = coded.dictionary.take(pa.array(code[first] // max(1, len(names)))), names.take(pa.array(code[first] % max(1, len(names))))
    return _batch(term, name, [*first, len(code)], ids.take(pa.array(order)), dl[order], pos[order])


def _batch(term: pa.Array, field: pa.Array, offsets: list[int], ids: pa.Array, dl: np.ndarray, pos: np.ndarray | None) -> pa.RecordBatch:
    at = pa.array(offsets, pa.int32())
    lists = [pa.ListArray.from_arrays(at, ids), pa.ListArray.from_arrays(at, pa.array(dl, pa.int32()))]
    lists.append(pa.nulls(len(term), pa.list_(pa.int32())) if pos is None else pa.ListArray.from_arrays(at, pa.array(pos, pa.int32())))
    return pa.RecordBatch.from_arrays([term, field, *lists], names=["term", "field", "ids", "dls", "poss"])


def opened(postings: DataFrame, *columns: str) -> DataFrame:
    """``columns``, id, dl and pos of every occurrence of the postings."""
    rows = postings.select(*columns, F.inline(F.arrays_zip("ids", "dls", "poss")).alias("id", "dl", "pos"))
    return rows.withColumn("dl", F.col("dl").cast("long"))


def stemmed(index: Index) -> Index:
    """The index for queries whose words are stemmed, as ``porter unicode61`` does."""
    return replace(index, porter=True)


def write_index(index: Index, path: str) -> None:
    """Postings, lengths, and of a stemmed index the vocabulary: each distinct term is stemmed once."""
    spark = index.postings.sparkSession
    write_postings(index.postings, path)
    if index.porter:
        write_vocabulary(spark, path)
    lengths = _documents(spark, path, index.lengths.schema["id"].dataType.simpleString())
    # a column of the lengths tells a stemmed index, so that both come from one write
    lengths = lengths.withColumn("porter", F.lit(True)) if index.porter else lengths
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def write_postings(postings: DataFrame, path: str) -> None:
    postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")


def _documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, dl) as the written postings tell it: texts are split once only."""
    rows = spark.read.schema(postings_schema(kind)).parquet(f"{path}/postings").where("term is null")
    return rows.select(F.inline(F.arrays_zip("ids", "dls")).alias("id", "dl")).withColumn("dl", F.col("dl").cast("long"))


def written_lengths(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (id and more) with ``dl`` as the postings at ``path`` tell it."""
    held = _documents(rows.sparkSession, path, rows.schema["id"].dataType.simpleString()).groupBy("id").agg(F.max("dl").alias("dl"))
    return rows.join(held, "id", "left").withColumn("dl", F.coalesce("dl", F.lit(0).cast("long")))


def write_vocabulary(spark: SparkSession, path: str) -> None:
    """The stem of each distinct term of the postings at ``path``."""
    terms = spark.read.schema("term string").parquet(f"{path}/postings").where("term is not null").distinct()
    terms.withColumn("stem", stem_of("term")).repartition("stem").sortWithinPartitions("stem").write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_index(spark: SparkSession, path: str) -> Index:
    lengths = spark.read.parquet(f"{path}/lengths")
    porter = "porter" in lengths.columns
    postings = spark.read.schema(postings_schema(lengths.schema["id"].dataType.simpleString())).parquet(f"{path}/postings")
    return Index(postings, lengths.drop("porter"), porter, spark.read.parquet(f"{path}/vocabulary") if porter else None)


def phrase_table(spark: SparkSession, queries: dict[object, list[list[str]]], key_type: str = "long") -> DataFrame:
    """(query_id, phrase, offset, term, size, phrases): the distinct phrases of every query, by their words also where
    the words are stemmed, as each counts in the full-text engine."""
    rows = []
    for query_id, found in queries.items():
        distinct = list(dict.fromkeys(map(tuple, found)))
        rows += [(query_id, " ".join(p), i, t, len(p), len(distinct)) for p in distinct for i, t in enumerate(p)]
    return local_table(spark, rows, f"query_id {key_type}, phrase string, offset int, term string, size int, phrases int")


def phrases_in(query: Column) -> Column:
    """As ``query_terms.phrases``: arrays of terms."""
    text = F.coalesce(query, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(QUERY_WORD), F.lit(0))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(text))
    return F.filter(F.transform(words, tokens), lambda p: F.size(p) > 0)


def phrases_of(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``phrase_table``, of the texts of a table."""
    rows = table.select(F.col(id_col).alias("query_id"), F.array_distinct(phrases_in(F.col(text_col))).alias("found"))
    rows = rows.select("query_id", F.size("found").alias("phrases"), F.explode("found").alias("p"))
    return rows.select("query_id", F.array_join("p", " ").alias("phrase"), F.size("p").alias("size"), "phrases", F.posexplode("p").alias("offset", "term"))


def _places(index: Index, phrases: DataFrame, small: bool) -> DataFrame:
    """(phrase, id, field, dl): where the phrases stand, once for each field of a row."""
    wanted = phrases.select("phrase", "offset", "term", "size").distinct()
    send = F.broadcast if small else lambda df: df
    postings = index.postings
    if index.porter:
        if small:
            # few words, which the driver stems
            rows = [(r["phrase"], r["offset"], r["size"], stem(r["term"])) for r in wanted.collect()]
            wanted = local_table(wanted.sparkSession, rows, "phrase string, offset int, size int, stem string")
        else:
            wanted = wanted.withColumn("stem", stem_of("term")).drop("term")
        if index.vocabulary is not None:
            wanted = index.vocabulary.join(send(wanted), "stem").drop("stem")
        else:
            # a stem begins as its word does
            first = wanted.select(F.left("stem", F.lit(1)).alias("first")).distinct()
            near = postings.join(send(first), F.left("term", F.lit(1)) == F.col("first"), "left_semi")
            postings = near.withColumn("term", stem_of("term"))
            wanted = wanted.withColumnRenamed("stem", "term")
    if small:
        wanted = settled(wanted)
        terms = [r[0] for r in wanted.select("term").distinct().limit(MOST_NAMED + 1).collect()]
        postings = postings.where(F.col("term").isin(terms)) if len(terms) <= MOST_NAMED else postings
    # the terms of a stem may be as many as its inflections; only those of few phrases are sent
    seg = ["seg"] if "seg" in postings.columns else []
    found = opened(postings.join(send(wanted), "term"), "phrase", "offset", "size", "field", *seg).withColumn("start", F.col("pos") - F.col("offset"))
    if index.dead is not None:
        found = found.alias("o").join(index.dead.alias("d"), (F.col("o.id") == F.col("d.id")) & (F.col("o.seg") < F.col("d.until")), "left_anti")
    return found.where("size = 1").select("phrase", "id", "field", "dl").union(
        found.where("size > 1").groupBy("phrase", "id", "field", "start", "size", "dl").count().where("`count` = size").select("phrase", "id", "field", "dl")
    )


def _is_small(phrases: DataFrame) -> bool:
    return phrases.limit(MOST_SENT + 1).count() <= MOST_SENT


def holders(index: Index, phrases: DataFrame) -> DataFrame:
    """(query_id, id) of the rows that have every phrase of a query, as ``match`` finds them, for phrases from a table.
    The rows with a query's rarest phrase are its candidates, and only they are looked up for the others."""
    whole = _places(index, phrases, _is_small(phrases)).select("phrase", "id").distinct()
    df = whole.groupBy("phrase").agg(F.count("*").alias("df"))
    owners = phrases.select("query_id", "phrase", "phrases").distinct()
    rare = owners.join(df, "phrase").groupBy("query_id", "phrases").agg(F.min(F.struct("df", "phrase"))["phrase"].alias("phrase"), F.count("*").alias("have"))
    some = rare.where("have = phrases").select("query_id", "phrase").join(whole, "phrase").select("query_id", "id")
    have = some.join(owners, "query_id").join(whole, ["phrase", "id"]).groupBy("query_id", "id", "phrases").agg(F.count("*").alias("have"))
    return have.where("have = phrases").select("query_id", "id")


def match(index: Index, phrases: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, id, score) of the rows that have every phrase of a query; higher is better.

    A phrase is its terms next to each other in one field. Its weighted count sums ``weights`` of the fields. What is
    sent to every task has at most a row for each phrase, and only if these are counted and few.
    """
    small = _is_small(phrases)
    send = F.broadcast if small else lambda df: df
    weight = F.lit(0.0)
    for field, w in weights.items():
        weight = F.when(F.col("field") == field, float(w)).otherwise(weight)
    tf = _places(index, phrases, small).groupBy("phrase", "id").agg(F.sum(weight).alias("tf"), F.max("dl").alias("dl"))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    if index.stats is not None:
        n, total = index.stats
        df = df.withColumns({"n": F.lit(n), "avgdl": F.lit(total / n if n else None).cast("double")})
    else:
        df = df.crossJoin(F.broadcast(index.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))))  # one row
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.select("phrase", "avgdl", F.when(raw <= 0, 1e-6).otherwise(raw).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(send(df), "phrase").select("phrase", "id", part.alias("part"))
    owners = phrases.select("query_id", "phrase", "phrases").distinct()
    every = scored.join(send(owners), "phrase").groupBy("query_id", "id", "phrases").agg(F.sum("part").alias("score"), F.count("*").alias("have"))
    return every.where("have = phrases").select("query_id", "id", "score")


def subject_scan(messages: DataFrame, query: str, id_col: str = "id") -> DataFrame:
    """Ids of the messages whose subject has every word of the query, as a substring."""
    subject = F.lower(F.coalesce("subject", F.lit("")))
    out = messages
    for word in (query or "").lower().split():
        pattern = word.replace("%", "")
        if pattern:
            out = out.where(subject.like(f"%{pattern}%"))
    return out.select(F.col(id_col).alias("id"))


def identifier_index(messages: DataFrame, id_col: str, text_cols: list[str]) -> Index:
    """An unstemmed index over the identifiers of each message, one field."""
    from ..functions.identifiers import extract_identifiers

    rows = messages.select(F.col(id_col).alias("id"), F.array_join(extract_identifiers(*text_cols), " ").alias("identifiers"))
    return build_index(rows, ["identifiers"])


def identifier_match(index: Index, identifiers: DataFrame) -> DataFrame:
    """(query_id, id, score) of rows that have any identifier of a query. ``identifiers``: query_id and identifiers, an array."""
    named = identifiers.select("query_id", F.explode("identifiers").alias("one")).select("query_id", tokens("one").alias("p")).where(F.size("p") > 0)
    named = named.select("query_id", F.array_join("p", " ").alias("phrase"), "p").distinct()
    phrases = named.select(F.col("phrase").alias("query_id"), "phrase", F.size("p").alias("size"), F.lit(1).alias("phrases"), F.posexplode("p").alias("offset", "term")).distinct()
    one = match(index, phrases, {"identifiers": 1.0, "message_id": 1.0}).withColumnRenamed("query_id", "phrase")
    send = F.broadcast if _is_small(named) else lambda df: df
    return one.join(send(named.select("query_id", "phrase")), "phrase").groupBy("query_id", "id").agg(F.sum("score").alias("score"))
