"""What a query shuffles and writes, which tells how it grows."""

from __future__ import annotations

from siftspark.operators import lexical, vector
from siftspark.operators.segments import SegmentedIndex
from siftspark.plans import retrieve as plan
from siftspark.plans.retrieve import Query, Store, filters, lexical_list, query_table, read_queries

FIELDS = ["subject", "body"]


def docs(spark, n=40):
    rows = [(i, "the sea", "the boat and the sea " * 30) for i in range(n)]
    return spark.createDataFrame(rows, "id long, subject string, body string").coalesce(2)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_written_without_a_shuffle_and_a_row_for_each_term(spark, tmp_path):
    index = lexical.build_index(docs(spark), FIELDS)
    assert "Exchange" not in planned(index.postings.sortWithinPartitions("term"))
    lexical.write_index(index, f"file://{tmp_path}/i")
    written = spark.read.parquet(f"file://{tmp_path}/i/postings")
    # two parts of four terms in the body and two in the subject, and the documents of each
    assert written.count() == 2 * (4 + 2 + 1)
    assert lexical.opened(written.where("term is not null"), "term").count() == 40 * (2 + 150)
    assert {tuple(r) for r in lexical.read_index(spark, f"file://{tmp_path}/i").lengths.collect()} == {(i, 152) for i in range(40)}


def test_blocks_are_cut_between_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 200)
    texts = spark.createDataFrame([(i, "", "sea boat " * (i * 30)) for i in range(8)], "id long, subject string, body string").coalesce(1)
    index = lexical.build_index(texts, FIELDS)
    listed = [sorted(r["ids"]) for r in index.postings.where("term is null").collect()]
    assert len(listed) > 2 and sorted(sum(listed, [])) == list(range(8))
    held = lexical.opened(index.postings.where("term = 'boat'"), "field").groupBy("id", "dl").count().collect()
    assert {tuple(r) for r in held} == {(i, i * 60, i * 30) for i in range(1, 8)}


def test_a_merge_shuffles_no_occurrences(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", FIELDS, id_type="long")
    index.upsert(docs(spark))
    index.upsert(docs(spark).where("id < 20"))
    found = index.segments()
    living = index._live(lexical.opened(index._part(found, "postings", lexical.postings_schema("long")).where("term is not null"), "term", "field", "seg"), found)
    merged = lexical.listed(living)
    assert "SortMergeJoin" not in planned(merged)
    assert lexical.opened(merged, "term").count() == 40 * 152


def test_equal_queries_are_matched_once(spark, monkeypatch):
    rows = docs(spark)
    messages = rows.selectExpr("id", "subject", "IF(id % 2 = 0, 'en', 'de') AS lane", "'2026-01-01' AS date_utc")
    asked = [Query(i, ("the boat", "and", "SEA")[i % 3], lane=(None, "en")[i % 2], after="2025-01-01" if i % 5 else None) for i in range(60)]
    asked.append(Query(60, "invoice sea"))
    seen = []
    real = plan.match
    monkeypatch.setattr(plan, "match", lambda index, phrases, weights: seen.append(phrases.select("query_id").distinct().count()) or real(index, phrases, weights))

    def ranks(queries):
        table = query_table(spark, queries)
        return sorted(map(tuple, lexical_list(Store(messages, lexical.build_index(rows, FIELDS), None), table, filters(read_queries(table)), 5).select("query_id", "variant", "id", "fts_rank").collect()))

    together = ranks(asked)
    assert seen == [4]
    alone = sorted(sum((ranks([asked[i]]) for i in (0, 1, 2, 7, 10, 60)), []))
    assert alone == [r for r in together if r[0] in (0, 1, 2, 7, 10, 60)] and len(together) == 300


def test_blocks_of_vectors_do_not_grow_with_partitions(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "message_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id long, v array<double>")
    given = []
    real = vector._best
    monkeypatch.setattr(vector, "_best", lambda near, k: given.append(near.count()) or real(near, k))
    had = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for parts in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append(sorted((r["query_id"], r["vec_rank"], r["id"]) for r in vector.knn_table(vectors, asked, 3).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert got[0] == got[1] and given[0] == given[1] <= 5 * 3 * spark.sparkContext.defaultParallelism


def test_only_texts_are_dealt_before_they_are_embedded(spark, monkeypatch, tmp_path):
    from siftspark.sources import schemas
    from siftspark.sources.tables import VersionedTable
    from siftspark.streaming import increment

    class Seen(Exception):
        pass

    def seen(todo, make):
        raise Seen(planned(todo))

    monkeypatch.setattr(increment, "embed_column", seen)
    rows = schemas.conform(docs(spark).selectExpr("CAST(id AS string) AS id", "subject"), schemas.MESSAGES).selectExpr("*", "concat(subject, ' and more') AS body")
    meta, vec = VersionedTable(spark, f"file://{tmp_path}/meta", schemas.META), VersionedTable(spark, f"file://{tmp_path}/vec", schemas.VECTORS)
    try:
        increment.embed_changed(rows, meta, vec, None, "2026-01-01T00:00:00Z", 2)
    except Seen as e:
        plan = str(e)
    assert plan.rindex("sha2(") < plan.index("Exchange hashpartitioning(id")


def test_texts_that_lack_what_a_pattern_needs_are_cut_as_before(spark):
    import re

    from pyspark.sql import functions as F

    from siftspark.functions import text as T

    ends = ["On Tue Ada WROTE:", "on x wrote: ", "-- Original Message --", "_____", "Begin forwarded message:", "FROM: a\nSent: b\nSubject: c", "-- ", "ſent from my iPhone", "sent FROM my IPAD", "get outſide", "Get OutlooK for x", "ſent from Mail for Wİndows", "nothing", "> quoted", "a\r\n\r\n\r\nb", "\x1c end 　"]
    rows = spark.createDataFrame([(i, f"kept line\n{e}\nlast\x1f ") for i, e in enumerate(ends)] + [(97, ""), (98, None), (99, "　")], "id long, t string")
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")

    def cut(c, patterns):
        return F.left(c, F.coalesce(F.least(*(F.nullif(F.regexp_instr(c, F.lit(p)), F.lit(0)) for p in patterns)) - 1, F.length(c)))

    lines = F.filter(F.split(cut(plain(F.col("t")), T.REPLY_SPLITS), "\n", -1), lambda x: ~F.ltrim(F.translate(x, "\t", " ")).startswith(">"))
    signed = cut(F.array_join(lines, "\n"), T.SIGNATURES)
    want = F.regexp_replace(F.regexp_replace(signed, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""), "\n{3,}", "\n\n")
    got = rows.select("id", T.clean_body("t").alias("got"), want.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in got) and sum(r["got"] == "kept line" for r in got) >= 9
    assert set(T._NEEDED) == set(T.REPLY_SPLITS + T.SIGNATURES) and not any(re.search("[ski]", x) for x in T._NEEDED.values())
