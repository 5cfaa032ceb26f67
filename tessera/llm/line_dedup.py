"""Line deduplication with a log-template tree, in DataFrame operations only.

A line falls down a tree of fixed depth: first by its token count, then by its
`LEAD` leading tokens, where a token with a digit is a variable field `<*>`, then
`SPLITS` times by the most frequent token that a fifth to a half of the node's lines
have at one position (a node of several templates parts into them, whatever else it
holds). In a leaf, positions on which more than half of the lines agree are constant and
the others become fields too; a line that shares at least `SIMILAR` of its tokens
with the leaf's constants takes the leaf's template, any other keeps its own masked
tokens. A template recurs when it stands in `DOCUMENTS` different documents (2 for lines
of more than `PASSAGE` tokens), alone or among other recurring lines. Recurring templates
are dropped from all documents.

Lines that recur because whole documents were copied are no templates: a document counts
for a line only where less than half of its other characters are, line by line, in other
documents too. Copies are left to document-level deduplication; so is a page of which
more than half is boilerplate, as nothing in it tells it from a copy.

Only hashes of lines are shuffled; texts stay where they are read, unless the
table of lines to drop is too large to be broadcast. Rows of very frequent lines meet
their decision in a broadcast, not in one task.

Defined results: a null text has one empty line and stays null; empty lines never
recur; repeated rows (equal doc_id and text) count once and are treated alike;
ties between tokens go to the earlier position, then the smaller token; an empty table
gives no rows; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, shared_table, small

LEAD, SPLITS, SPLIT_SHARE, SIMILAR, DOCUMENTS, PASSAGE, COPY_SHARE = 3, 2, 0.2, 0.7, 3, 50, 0.5
#: Rows of one line that make it a hot one; at most one in so many rows names one.
HOT_LINES = 10_000


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _masked(line: Column) -> tuple[Column, Column]:
    """A line without outer and repeated blanks, and the same with its fields masked."""
    line = F.btrim(line, F.lit(" \t\r"))
    uneven = line.contains("  ") | line.contains("\t") | line.contains("\r")
    plain = F.when(uneven, F.regexp_replace(line, r"[ \t\r]+", " ")).otherwise(line)
    return plain, F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", "<*>")).otherwise(plain)


def parsed(docs: DataFrame) -> DataFrame:
    """doc, pos, tokens, leaf, key, chars of every line that isn't empty."""
    lines = docs.select(_key().alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    plain, masked = _masked(F.col("line"))
    lines = lines.select("doc", "pos", plain.alias("line"), masked.alias("masked")).where("line <> ''")
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("doc", "pos", F.length("line").alias("chars"), tokens.alias("tokens"), F.substring_index("masked", " ", LEAD).alias("lead"), F.xxhash64("masked").alias("key"))
    return lines.select("doc", "pos", "chars", "tokens", F.xxhash64("tokens", "lead").alias("leaf"), "key")


def _token(p: Column) -> Column:
    return F.try_element_at(F.split("masked", " "), p + 1)


def _counts(kinds: DataFrame) -> DataFrame:
    """How many of a node's lines have a token at a position."""
    words = kinds.select("leaf", "lines", "n", F.posexplode(F.split("masked", " ")).alias("p", "token"))
    return words.groupBy("leaf", "p", "token").agg(F.sum("n").alias("c"), F.first("lines").alias("lines"))


def generalised(spark: SparkSession, docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(key, template): masked lines that take their leaf's template. Each different line is read from one document."""
    leaves = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("lines")).where(f"keys > 1 and lines >= {DOCUMENTS}").select("leaf", "lines")
    asked = kinds.join(small(shared_table(spark, leaves, "leaves")), "leaf").groupBy("at.doc").agg(F.collect_list(F.struct("at.pos", "leaf", "key", "tokens", "lines", "n")).alias("asked"))
    asked = shared_table(spark, asked, "lines-asked")
    held = docs.select(_key().alias("doc"), "text").join(small(asked), "doc").select("asked", F.split("text", "\n").alias("all")).select("all", F.inline("asked"))
    mixed = held.select("leaf", "key", "tokens", "lines", "n", _masked(F.element_at("all", F.col("pos") + 1))[1].alias("masked")).dropDuplicates(["leaf", "key"])
    mixed = shared_table(spark, mixed, "line-kinds")
    for _ in range(SPLITS):
        best = _counts(mixed).where(f"c * 2 <= lines and c >= {SPLIT_SHARE} * lines and c >= {DOCUMENTS}").groupBy("leaf").agg(F.min(F.struct((-F.col("c")).alias("c"), "p", "token")).alias("best"))
        best = shared_table(spark, best, "splits")
        has, count = F.coalesce(_token(F.col("best.p")) == F.col("best.token"), F.lit(False)), -F.col("best.c")
        mixed = mixed.join(small(best), "leaf", "left").select(
            F.when(F.col("best").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", has.cast("int"))).alias("leaf"), "key", "tokens",
            F.when(F.col("best").isNull(), F.col("lines")).when(has, count).otherwise(F.col("lines") - count).alias("lines"), "n", "masked",
        )
        mixed = shared_table(spark, mixed, "line-kinds")
    # A position has one majority at most, so these lists are no longer than a line.
    constant = _counts(mixed).where("c * 2 > lines").groupBy("leaf").agg(F.collect_list(F.struct("p", "token")).alias("constant"))
    met = mixed.join(small(shared_table(spark, constant, "constants")), "leaf").withColumn("words", F.split("masked", " "))
    same = F.size(F.filter("constant", lambda c: F.try_element_at("words", c["p"] + 1) == c["token"]))
    return met.where(same >= F.lit(SIMILAR) * F.col("tokens")).select("key", F.xxhash64(F.lit("leaf"), "leaf").alias("template"))


def _meet(spark: SparkSession, rows: DataFrame, side: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """rows joined to side by key; rows of hot keys meet theirs in a broadcast."""
    few = small(hot)
    cold = rows.join(few, "key", "left_anti").join(side, "key", how)
    known = shared_table(spark, side.join(few, "key", "left_semi"), "met-by-hot-lines")
    return cold.unionByName(rows.join(few, "key", "left_semi").join(small(known), "key", how))


def recurring(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc, pos of every line whose template recurs; doc is the hash of doc_id and text."""
    rows = parsed(docs).dropDuplicates(["doc", "pos"])
    rows = shared_table(spark, rows, "line-keys")
    kinds = shared_table(spark, rows.groupBy("leaf", "key", "tokens").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("at")), "line-counts")
    templates = shared_table(spark, generalised(spark, docs, kinds), "templates")
    hot = shared_table(spark, kinds.where(F.col("n") >= HOT_LINES).select("key").distinct(), "hot-lines")
    rows = _meet(spark, rows, templates, hot, "left").select("doc", "pos", "chars", "tokens", F.coalesce("template", "key").alias("key"))
    rows = shared_table(spark, rows, "line-templates")
    # How much of each document other documents hold too.
    seen = shared_table(spark, rows.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("key", "n"), "shared-lines")
    hot = shared_table(spark, seen.where(F.col("n") >= HOT_LINES).select("key"), "hot-templates")
    marked = _meet(spark, rows, seen, hot, "left").select("doc", "key", "tokens", "chars", F.when(F.col("n").isNotNull(), F.col("chars")).otherwise(0).alias("twice"))
    whole = Window.partitionBy("doc")
    near = marked.withColumn("all_twice", F.sum("twice").over(whole)).withColumn("all", F.sum("chars").over(whole)).where("twice > 0")
    near = near.where((F.col("all") > F.col("chars")) & (F.col("all_twice") - F.col("twice") < F.lit(COPY_SHARE) * (F.col("all") - F.col("chars"))))
    # Different documents, counted in two steps so that no key's rows meet in one task.
    distinct = near.groupBy("key", "doc").agg(F.max("tokens").alias("tokens"))
    counted = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.max("tokens").alias("tokens"))
    keys = counted.where(F.col("documents") >= F.when(F.col("tokens") > PASSAGE, 2).otherwise(DOCUMENTS)).select("key")
    return _meet(spark, rows, shared_table(spark, keys, "recurring-lines"), hot, "left_semi").select("doc", "pos")


def drop_lines(spark: SparkSession, docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with n_lines and n_dropped (behind prefix) added, and without the lines whose template recurs. Where docs has such columns, the new ones get underscores behind."""
    ident, gone = free(docs.columns, "_doc", "_drop")
    n_lines, n_dropped = free(docs.columns, f"{prefix}n_lines", f"{prefix}n_dropped")
    drop = recurring(spark, docs.select("doc_id", F.col("text").cast("string").alias("text"))).groupBy("doc").agg(F.collect_set("pos").alias(gone))
    drop = shared_table(spark, drop.withColumnRenamed("doc", ident), "lines-to-drop")
    out = docs.withColumn("text", F.col("text").cast("string")).withColumn(ident, _key()).join(small(drop), ident, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return out.select(
        *[F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(1)).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped),
    )


#: One split of all nodes: the most frequent token that a fifth to a half of the lines have.
_ROUNDS = "".join(
    f"""cells{r} as (select tokens, lead, branch, n, lines, unnest(words) as word, generate_subscripts(words, 1) as p from kinds{r}),
often{r} as (select tokens, lead, branch, p, word, sum(n) as c from cells{r} group by tokens, lead, branch, p, word having sum(n) * 2 <= any_value(lines) and sum(n) >= {SPLIT_SHARE} * any_value(lines) and sum(n) >= {DOCUMENTS}),
best{r} as (select * from (select *, row_number() over (partition by tokens, lead, branch order by c desc, p, word) as nth from often{r}) where nth = 1),
kinds{r + 1} as (select k.tokens, k.lead, k.masked, k.words, k.n, case when b.c is null then k.lines when k.words[b.p] = b.word then b.c else k.lines - b.c end as lines,
  k.branch || case when b.c is null then '-' when k.words[b.p] = b.word then '1' else '0' end as branch from kinds{r} k left join best{r} b using (tokens, lead, branch)),
"""
    for r in range(SPLITS)
)
#: The same in DuckDB's SQL, over strings instead of hashes.
SQL = rf"""
with docs as (select distinct doc_id, text from documents),
split as (select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos from docs),
plain as (select doc_id, text, pos, regexp_replace(regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g'), '[ \t\r]+', ' ', 'g') as line from split),
masked as (select doc_id, text, pos, length(line) as chars, string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') as words from plain where line <> ''),
leafed as (select *, len(words) as tokens, array_to_string(words[1:{LEAD}], ' ') as lead, array_to_string(words, ' ') as masked from masked),
kinds as (select tokens, lead, masked, any_value(words) as words, count(*) as n from leafed group by tokens, lead, masked),
leaves as (select tokens, lead, sum(n) as lines from kinds group by tokens, lead having count(*) > 1 and sum(n) >= {DOCUMENTS}),
kinds0 as (select k.tokens, k.lead, k.masked, k.words, k.n, l.lines, '' as branch from kinds k join leaves l using (tokens, lead)),
{_ROUNDS}cells as (select tokens, lead, branch, masked, n, lines, unnest(words) as word, generate_subscripts(words, 1) as p from kinds{SPLITS}),
fixed as (select tokens, lead, branch, p, word from cells group by tokens, lead, branch, p, word having sum(n) * 2 > any_value(lines)),
taken as (select c.tokens, c.lead, c.branch, c.masked from cells c join fixed f using (tokens, lead, branch, p, word) group by c.tokens, c.lead, c.branch, c.masked having count(*) >= {SIMILAR} * c.tokens),
keyed as (select d.doc_id, d.text, d.pos, d.chars, d.tokens, case when t.masked is null then 'm ' || d.masked else 'l ' || d.tokens || ' ' || t.branch || ' ' || d.lead end as key from leafed d left join taken t on d.masked = t.masked),
ids as (select *, row_number() over () as doc from docs),
rows_ as (select i.doc, k.* from keyed k join ids i on k.doc_id is not distinct from i.doc_id and k.text is not distinct from i.text),
shared as (select key from rows_ group by key having min(doc) <> max(doc)),
marked as (select *, case when key in (select key from shared) then chars else 0 end as twice from rows_),
beside as (select key, doc, tokens, chars, twice, sum(twice) over (partition by doc) as all_twice, sum(chars) over (partition by doc) as all_chars from marked),
near as (select * from beside where twice > 0 and all_chars > chars and all_twice - twice < {COPY_SHARE} * (all_chars - chars)),
often as (select key from near group by key having count(distinct doc) >= case when max(tokens) > {PASSAGE} then 2 else {DOCUMENTS} end),
gone as (select distinct doc_id, text, pos from rows_ where key in (select key from often)),
told as (select s.doc_id, s.text, count(*) as n_lines, count(g.pos) as n_dropped, string_agg(case when g.pos is null then s.line end, chr(10) order by s.pos) as kept
  from split s left join gone g on s.doc_id is not distinct from g.doc_id and s.text is not distinct from g.text and s.pos = g.pos group by s.doc_id, s.text)
select d.doc_id, t.n_lines::bigint as n_lines, t.n_dropped::bigint as n_dropped, case when d.text is null then null else coalesce(t.kept, '') end as text
from documents d join told t on d.doc_id is not distinct from t.doc_id and d.text is not distinct from t.text
"""
