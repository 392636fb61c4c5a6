import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skein.llm import benchmark, lines, mixing, near, oracles, quality, queries


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before each stage, and the result."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in P.STAGES:
        out.append(docs)
        docs = P.store.cut(stage(spark, docs, sf), "test-stage")
    return [*out, docs]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_apply_their_operators(spark, sf, stages):
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    first, rejected, lined, distinct, clean, mixed = stages
    scores = quality.score_quality(first, quality.fit_quality(labels, first))
    assert ids(rejected) == ids(scores.where("predicted = 1")) != ids(first)
    deduped = lines.dedup_lines(rejected, most_dropped=P.MOST_LINES_DROPPED).collect()
    assert ids(lined) == {r["doc_id"] for r in deduped if not r["n_dropped"] or r["text"].split()} != ids(rejected)
    dropped = {r["doc_id"]: r["n_dropped"] for r in deduped}
    texts = {r["doc_id"]: r["text"] for r in rejected.collect()}
    for r in lined.collect():
        assert (r["text"] == texts[r["doc_id"]]) == (dropped[r["doc_id"]] == 0) and r["n_chars"] == (len(r["text"]) if dropped[r["doc_id"]] else r["n_chars"])
    assert ids(distinct) == ids(near.near_duplicates(lined).where("kept"))
    assert ids(clean) == ids(benchmark.contamination(distinct, items).where("not contaminated"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    assert all(df.columns == first.columns for df in stages[:-1])


def test_run(spark, sf, stages):
    since = P.store.mark()
    got = P.run(spark, sf)
    assert P.store.mark() == since + 1  # nothing but the result is left
    assert got.exceptAll(stages[-1]).count() == 0 and got.count() == stages[-1].count()


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    odd = docs.limit(3).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")})
    for name, stage in P.STAGES[1:-1]:
        assert stage(spark, odd, sf).count() == 3, name


def test_odd_documents(spark, sf, odd):
    """Nulls, empty and very long texts, repeats and clashing column names, in every stage by itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = odd.withColumns({"lang": F.lit("en"), "n_chars": F.char_length("text").cast("long")})
    whole = docs.unionByName(extra, allowMissingColumns=True)
    forest = quality.fit_quality(spark.read.parquet(f"{sf}/labels.parquet"), whole)
    scored = quality.score_quality(extra, forest)
    assert P.quality_stage(spark, whole, sf).where("k1 is not null").count() == scored.where("predicted = 1").count()
    assert P.lines_stage(spark, extra, sf).count() == extra.count()
    near_ = P.near_stage(spark, extra, sf)
    assert near_.where("doc_id = 4").count() == 1 and near_.where("text is null").count() == 2
    assert P.benchmark_stage(spark, extra, sf).count() == extra.count()
    mixed = P.mixing_stage(spark, extra, sf)
    assert mixed.where("text is null or trim(text) = ''").count() == 0 and "own k1" in {r["k1"] for r in mixed.select("k1").collect()}


def test_labels_and_items_with_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet").withColumns({c: F.lit("own") for c in ("text_", "label", "k", "score", "source", "lang", "id", "word", "n")}) for t in ("labels", "benchmark"))
    assert quality.score_quality(docs, quality.fit_quality(labels, docs)).count() == docs.count()
    assert {r["doc_id"] for r in benchmark.contamination(docs, items).where("contaminated").collect()} == {r["doc_id"] for r in benchmark.contamination(docs, items.select("item_id", "text")).where("contaminated").collect()}


def test_pages_of_mostly_boilerplate_lose_it(spark, make):
    frame = "Home About Contact\nsign up for our letter\nterms and privacy\nall rights reserved"
    docs = make([(i, f"{frame}\nown story {'abcdefghijkl'[i]}") for i in range(12)]).withColumn("n_chars", F.char_length("text").cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.lines_stage(spark, docs, "").collect()}
    assert got[0][0].startswith(frame) and all(got[i] == (f"own story {'abcdefghijkl'[i]}", 11) for i in range(1, 12))


def test_copies_go_and_their_original_stays(spark, make):
    story = "\n".join(f"line {w} of a story" for w in ("one", "two", "three"))
    docs = make([(1, story), (2, story), (3, story), (4, ""), (5, None), (6, "own words")]).withColumn("n_chars", F.char_length("text").cast("long"))
    assert {r["doc_id"]: r["text"] for r in P.lines_stage(spark, docs, "").collect()} == {1: story, 4: "", 5: None, 6: "own words"}


def test_registry(spark, sf):
    assert [f"op{i}" for i in range(1, 11)] == [n.split("_")[0] for n in queries()]
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in oracles().items():
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        expected = sorted(map(str, found.fetchall()))
        got = sorted(str(tuple(r[c] for c in columns)) for r in queries()[name](spark, sf).collect())
        assert got == expected, name
