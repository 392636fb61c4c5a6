"""Line dedup by a log-template tree. [native]

A line is its tokens between spaces; a token with a digit is a variable field ``<*>``. The tree has a
fixed depth: token count, then the first ``depth`` tokens. In its leaf a line stands for several
templates: itself, and, if it has ``least_tokens`` tokens, itself with one run of its other
tokens (one of ``fields`` equal shares) generalised to a field. A template that ``min_docs``
documents share recurs; a line with such a template is dropped, except in the document of
least id that has the template. Leaves that too few lines reach are pruned before any template is
counted, so only what may recur is shuffled by template; the rows of a very common template are dealt over several tasks.

A document of which more than ``most_dropped`` of the lines would go is left whole, whether it is a
copy or a page with much boilerplate (1.0: none is).

Nulls: a null text has no lines and stays null; a null id counts as the greatest. Blank lines are never
templates and are kept. Repeated rows count as one document. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.skew import join_counted
from skein.llm.store import cut, free_name

DEPTH, FIELDS, LEAST_TOKENS, MIN_DOCS = 3, 3, 9, 2
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line with each token that has a digit as a field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(line)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: Catalyst would copy their expressions to each use,
    but doesn't look into a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def templates(lines: DataFrame, depth: int, fields: int, least_tokens: int) -> DataFrame:
    """A row for each template of each line (tokens, n), in 128 bits: itself, and each share of the later tokens generalised."""
    which = F.when(F.col("n") >= least_tokens, F.array(*map(F.lit, range(fields + 1)))).otherwise(F.array(F.lit(0)))
    each = lines.withColumn("i", F.explode(which))
    rest, i = F.col("n") - depth, F.col("i")
    a = F.when(i == 0, F.col("n")).otherwise(F.floor(rest * (i - 1) / fields) + depth).cast("int")
    b = F.when(i == 0, F.col("n")).otherwise(F.floor(rest * i / fields) + depth).cast("int")
    each = once(each, head=F.slice("tokens", F.lit(1), a), tail=F.slice("tokens", b + 1, F.col("n")))
    return each.select("doc_id", "k", "pos", "leaf", F.xxhash64("i", "n", "head", "tail").alias("t1"), F.xxhash64(F.lit(-7), "i", "n", "head", "tail").alias("t2"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, fields: int = FIELDS, least_tokens: int = LEAST_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """For documents (doc_id, text, k): k, id and the positions, from 0, of lines with a recurring template."""
    lines = docs.select("doc_id", "k", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = once(lines, tokens=F.array_remove(F.split(masked(F.col("line")), " "), "")).drop("line")
    lines = once(lines, n=F.size("tokens"), leaf=F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))).where("n > 0")
    leaves = cut(lines.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs), "leaves")
    placed = templates(lines, depth, fields, least_tokens)
    most = leaves.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    live = join_counted(placed, leaves, ["leaf"], "lines", most, "left_semi")
    each = cut(live.groupBy("t1", "t2", "doc_id", "k").agg(F.collect_set("pos").alias("at")), "templates")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    common = cut(each.groupBy("t1", "t2").agg(F.count("*").alias("docs"), F.min(first).alias("first")).where(F.col("docs") >= min_docs), "common")
    later = join_counted(each, common, ["t1", "t2"], "docs", each.count()).where(first > F.col("first"))
    return later.select("doc_id", "k", F.explode("at").alias("pos")).groupBy("doc_id", "k").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, most_dropped: float = 1.0, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs, all their columns, with the text that is left, and n_lines and n_dropped
    (with underscores added if docs has such columns)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    gone = dropped_lines(rows.select("doc_id", "text", "k").where("text is not null"), min_docs=min_docs).select(F.col("doc_id").alias("gone_id"), F.col("k").alias("gone_k"), "gone")
    found = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("k") == F.col("gone_k")), "left")
    lines = F.split("text", "\n")
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    drop = F.col("gone").isNotNull() & (F.size("gone") <= F.lit(most_dropped) * total)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(drop, left).otherwise(F.col("text"))
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns, total.cast("long").alias(free_name("n_lines", docs.columns)), F.when(drop, F.size("gone")).otherwise(0).cast("long").alias(free_name("n_dropped", docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
m AS (SELECT r, doc_id, pos, list_filter(string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '{FIELD}', 'g'), ' '), lambda x: x <> '') AS t FROM l),
f AS (SELECT r, doc_id, pos, t, len(t) AS n, unnest(CASE WHEN len(t) >= {LEAST_TOKENS} THEN range(0, {FIELDS + 1}) ELSE [0] END) AS i FROM m WHERE len(t) > 0),
tpl AS (SELECT r, doc_id, pos, CASE WHEN i = 0 THEN [0::VARCHAR] || t
          ELSE [i::VARCHAR, n::VARCHAR] || list_slice(t, 1, ((n - {DEPTH}) * (i - 1)) // {FIELDS} + {DEPTH}) || list_slice(t, ((n - {DEPTH}) * i) // {FIELDS} + {DEPTH} + 1, n) END AS tp FROM f),
c AS (SELECT tp, min(doc_id) AS least FROM tpl GROUP BY tp HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT r, pos FROM tpl JOIN c USING (tp) WHERE doc_id > least),
left_ AS (SELECT l.r, count(gone.pos) AS n, string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN gone ON gone.r = l.r AND gone.pos = l.pos GROUP BY l.r)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(left_.text, '')) END AS text_sha256 FROM d LEFT JOIN left_ USING (r)
"""
