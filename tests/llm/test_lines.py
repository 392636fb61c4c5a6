from collections import defaultdict

from pyspark.sql import functions as F

from skein.llm import lines as L


def brute(rows, min_docs):
    """The kept text of each (id, text)."""
    having, lines_of = defaultdict(set), {}
    for i, text in rows:
        for pos, line in enumerate(text.split("\n")):
            tokens = [L.FIELD if any(c.isdigit() for c in t) else t for t in line.split()]
            n = len(tokens)
            if not n:
                continue
            found = [(0, *tokens)]
            for k in range(L.FIELDS if n >= L.LEAST_TOKENS else 0):
                a, b = ((n - L.DEPTH) * x // L.FIELDS + L.DEPTH for x in (k, k + 1))
                found.append((k + 1, n, *tokens[:a], None, *tokens[b:]))
            lines_of[i, pos] = found
            for t in found:
                having[t].add(i)
    gone = {key for key, found in lines_of.items() if any(len(having[t]) >= min_docs and key[0] != min(having[t]) for t in found)}
    return {i: "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone) for i, text in rows}


def corpus():
    rows = []
    for i in range(12):
        field = ["north", "south", "east", "west"][i % 4] * (1 + i // 4)
        rows.append((i, f"own words {'x' * i} here\nPage {i} of 10\nyou are reading the daily {field} paper of our small town today\n\nunique line of {'y' * i}"))
    return rows + [(20, "Page 3 of 10"), (21, "short\nshort"), (22, "own words here")]


def test_against_brute_force(make):
    rows = corpus()
    got = {r["doc_id"]: r for r in L.dedup_lines(make(rows), min_docs=5).collect()}
    expected = brute(rows, 5)
    assert {i: r["text"] for i, r in got.items()} == expected
    assert expected[20] == "" and "daily" not in expected[7] and "daily" in expected[0]
    assert all(r["n_lines"] == "own n_lines" and r["n_lines_"] - r["n_dropped"] == len(brute([(i, expected[i])], 99)[i].split("\n")) for i, r in got.items() if expected[i])


def test_native(spark, make):
    plan = L.dedup_lines(make(corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_are_left_whole(make):
    docs = make([(i, "a b c\nd e f\ng h i") for i in range(9)])
    assert {r["text"] for r in L.dedup_lines(docs, most_dropped=0.5, min_docs=3).collect()} == {"a b c\nd e f\ng h i"}
    assert [r["text"] for r in L.dedup_lines(docs, min_docs=3).orderBy("doc_id").collect()] == ["a b c\nd e f\ng h i"] + [""] * 8


def test_two_documents_make_a_line_recur(make):
    rows = [(1, "own one\nshared by two"), (2, "shared by two\nown two\nshared by three"), (3, "shared by three"), (4, "own four\nshared by three")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(make(rows)).collect()}
    assert got == brute(rows, 2) == {1: "own one\nshared by two", 2: "own two\nshared by three", 3: "", 4: "own four"}


def test_odd_rows(odd, none):
    got = L.dedup_lines(odd, min_docs=1)
    assert got.count() == odd.count() and got.select(odd.columns).exceptAll(odd).count() == 0
    assert L.dedup_lines(none).count() == 0
    repeated = L.dedup_lines(odd.where("doc_id = 4").unionByName(odd.where("doc_id = 4").withColumn("doc_id", F.lit(5))), min_docs=2)
    assert sorted((r["doc_id"], r["text"]) for r in repeated.collect()) == [(4, "one"), (4, "one"), (5, ""), (5, "")]
