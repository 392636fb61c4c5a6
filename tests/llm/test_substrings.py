import hashlib
import random
from collections import Counter

import pytest

from skein.llm import substrings as S


def brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[s : s + width]) for _, w in words for s in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - width + 1) if count[tuple(w[s : s + width])] > 1 for p in range(s, s + width)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(2)
    word = lambda: f"w{r.randrange(60)}"
    shared = [[word() for _ in range(n)] for n in (50, 36, 35, 34, 120)]
    rows = []
    for i in range(40):
        words = [word() for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(shared)
        rows.append((i, (" \n\t"[i % 3]).join(words)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "same " * 90), (53, "same " * 36), (54, " ".join(shared[4] + shared[4]))]
    return rows


def got(docs, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in S.dedup_substrings(docs, **options).collect()), key=str)


def test_against_brute_force(make):
    rows = corpus()
    assert got(make(rows)) == brute(rows, 35)
    assert got(make(rows), batches=3, window=20) == brute(rows, 20)
    assert got(make(rows), batches=1, window=3) == brute(rows, 3)


def test_spans_are_what_was_cut(make):
    rows = dict(corpus())
    for r in S.dedup_substrings(make(list(rows.items()))).collect():
        words = rows[r["doc_id"]].split()
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert " ".join(w for p, w in enumerate(words) if not any(s["start"] <= p < s["stop"] for s in r["spans"])) == r["text"]


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows, 35)
    assert got(none) == []


def counts(index):
    return {r["h"]: r["n"] for r in index.read().groupBy("h").agg({"n": "sum"}).toDF("h", "n").collect()}


def test_index_merges_by_level_and_reopens(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = S.FingerprintIndex(spark, path)
    assert index.repeated().count() == 0
    given = Counter()
    for k in range(18):
        batch = [k, k, k + 1, 100]
        given.update(batch)
        index.add(spark.createDataFrame([(h,) for h in batch], "h long"))
        index.compact()
        assert len(index.runs) <= 7  # three of each level at most, and one that is new
    assert counts(index) == given
    assert sorted(r["h"] for r in index.repeated().collect()) == sorted(h for h, n in given.items() if n > 1)
    # a run without its mark was not finished; a run that a whole one replaces is not read
    (tmp_path / "index" / "run-900-0").mkdir()
    spark.createDataFrame([(7, 50)], "h long, n long").write.parquet(f"{path}/run-19-1-15-16-17-18")
    assert any("-19" in x for x in index.runs)
    again = S.FingerprintIndex(spark, path)
    assert again.runs == index.runs and counts(again) == given and not (tmp_path / "index" / "run-900-0").exists()


def test_windows_must_be_equal_word_for_word(make):
    from test_text import twins

    one, two = twins(12)
    shared = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*shared, one])), (2, " ".join([*shared, two])), (3, " ".join([*shared, "other"])), (4, " ".join(shared))]
    assert got(make(rows)) == brute(rows, 35)
    rows.append((5, " ".join([*shared, two])))
    assert got(make(rows)) == brute(rows, 35)


def test_a_very_common_passage(make, monkeypatch):
    """A window that a third of all rows hold is dealt over many tasks, with the same result."""
    monkeypatch.setattr("skein.llm.skew.HEAVY", 16)
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join([f"x{r.random()}" for _ in range(8)] + ([passage] if i % 3 == 0 else []) + [f"y{r.random()}"])) for i in range(120)]
    assert got(make(rows)) == brute(rows, 35)


def test_later_batches_meet_history(spark, make, tmp_path):
    rows = corpus()
    parts, path = (rows[:20], rows[20:35], rows[35:]), f"file://{tmp_path}/index"
    seen = []
    for part in parts:
        seen += part
        expected = [x for x in brute(seen, 20) if x[0] in dict(part)]
        assert got(make(part), window=20, index=S.FingerprintIndex(spark, path)) == expected
        assert expected != brute(part, 20) or part is parts[0]
    with pytest.raises(ValueError):
        S.dedup_substrings(make(rows), window=21, index=S.FingerprintIndex(spark, path))


def test_query_digest(spark, sf):
    r = S.query(spark, sf).where("n_removed > 0").first()
    text = S.dedup_substrings(spark.read.parquet(f"{sf}/documents.parquet")).where(f"doc_id = {r['doc_id']}").first()["text"]
    assert r["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
