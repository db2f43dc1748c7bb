"""Benchmark decontamination with a positional inverted index (operator 4). DataFrame functions only.

Method. 1. Occurrences in the corpus are counted for all terms of the benchmark. 2. Every window of an item takes its two
rarest terms as anchors; postings (term, document, position) of the anchors are stored. 3. The posting lists meet offset-adjusted: an
occurrence of a window has both its anchors on the same diagonal (position minus offset in the item), so diagonals with at least two
anchors are candidates; two anchors of one item on diagonals at most `slop` apart are a proximity match. 4. Along each candidate diagonal
the words are compared one by one: exact phrase matches. Postings of the other terms would only repeat the texts, so these words are read from the texts.

Terms are matched by lower() and confirmed by the exact rule (only A-Z are lower-cased). A side is broadcast
only after its rows are counted; beyond the bound the joins on terms and items are salted, so that a common word is not one task. Rows that are equal in id and text leave one set of
postings and matches: copies are collapsed where they are found, before the shuffle.

Defined cases. Null or wordless texts and items: nothing found. An item shorter than a window is one window. Equal items are searched
once and reported each. Repeated rows get equal results. Empty benchmark: nothing found. Further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop, met, stage, table, unused

WINDOW, SLOP = 10, 5
#: Rows up to which a table of terms or of candidate documents is broadcast.
MAX_TERMS, MAX_DOCS = 500_000, 200_000
#: Candidate diagonals (under 150 bytes each) up to which they are broadcast, and in one row.
MAX_CANDS, ROW_CANDS = 150_000, 1000
#: What separates words before A-Z are lower-cased.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, case as it stands."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR, -1), "")


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items: gid, iw (lower-cased words), ids (their item_ids), win."""
    iw = F.transform(words(F.col("text")), lambda x: F.translate(x, UPPER, LOWER))
    b = benchmark.select(F.col("item_id").cast("string").alias("id"), iw.alias("iw")).where("size(iw) > 0 and id is not null")
    b = b.groupBy("iw").agg(F.collect_set("id").alias("ids"))
    return b.select(F.sha2(F.array_join("iw", " "), 256).alias("gid"), "iw", "ids", F.least(F.size("iw"), F.lit(WINDOW)).alias("win"))


def tokens(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, th, pos, key: all words with their positions."""
    d = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return d.select("doc_id", "th", "pos", F.lower("word").alias("key"))


def anchors_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """gid, off, key, len: the two rarest terms of every window of every item."""
    terms = items.select("gid", F.posexplode("iw").alias("off", "term")).withColumn("key", F.lower("term"))
    vocab = stage(terms.select("key").distinct(), "vocab")
    counts = stage(met(tokens(docs), vocab, ["key"], MAX_TERMS, ["th", "pos"], "left_semi").groupBy("key").agg(F.count("*").alias("n")), "counts")
    known = terms.join(counts, "key", "left").select("gid", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "key").alias("x"))
    by = known.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct(F.col("x.off").alias("o"), "x"))).alias("xs")).join(items.select("gid", "win"), "gid")
    by = by.withColumn("xs", F.expr("transform(xs, y -> y.x)"))
    pick = F.expr("array_distinct(flatten(transform(sequence(0, size(xs) - win), s -> slice(array_sort(slice(xs, s + 1, win)), 1, 2))))")
    return by.select("gid", F.size("xs").alias("len"), "win", F.explode(pick).alias("x")).select("gid", "len", "win", "x.off", "x.key")


def hits_of(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings of the anchors, offset-adjusted: doc_id, th, gid, off, diag, len, win."""
    keys = stage(anchors.select("key").distinct(), "anchors")
    postings = stage(met(tokens(docs), keys, ["key"], MAX_TERMS, ["th", "pos"], "left_semi").distinct(), "postings")
    return met(postings, anchors, ["key"], MAX_TERMS, ["th", "pos"]).select("doc_id", "th", "gid", "off", (F.col("pos") - F.col("off")).alias("diag"), "len", "win")


def proximity(hits: DataFrame, slop: int = SLOP) -> DataFrame:
    """doc_id, th, gid where two anchors of an item stand within slop words of their places to each other."""
    w = W.partitionBy("doc_id", "th", "gid").orderBy("diag", "off")
    near = hits.select("doc_id", "th", "gid", (F.col("diag") - F.lag("diag").over(w)).alias("d"), (F.col("off") != F.lag("off").over(w)).alias("other"))
    return near.where(F.col("other") & (F.col("d") <= slop)).select("doc_id", "th", "gid").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_hit, n_items, ids, n_near for the documents that have an exact or a proximity match; staged."""
    core = docs.select("doc_id", "text")
    items = stage(items_of(benchmark), "items")
    anchors = stage(anchors_of(core, items), "windows")
    hits = stage(hits_of(core, anchors), "diagonals")
    near = proximity(hits).groupBy("doc_id", "th").agg(F.count("*").alias("n_near"))
    cand = hits.groupBy("doc_id", "th", "gid", "diag", "len", "win").agg(F.count("*").alias("n")).where((F.col("n") >= 2) | (F.col("win") == 1))
    cand = stage(cand, "diagonals")
    many = cand.groupBy(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th")).agg((1 + F.floor(F.count("*") / ROW_CANDS)).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("gid", "diag"), F.coalesce("parts", F.lit(1)))
    dealt = cand.join(many, (F.col("th") == F.col("m_th")) & F.col("doc_id").eqNullSafe(F.col("m_id")), "left").withColumn("part", part)
    rows = stage(dealt.groupBy(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "part").agg(F.collect_list(F.struct("gid", "diag", "len", "win")).alias("cs")), "candidates")
    few = F.broadcast(rows) if cand.limit(MAX_CANDS + 1).count() <= MAX_CANDS else rows
    d = core.where("text is not null").withColumn("th", F.xxhash64("text"))
    d = d.join(few, (F.col("th") == F.col("c_th")) & F.col("doc_id").eqNullSafe(F.col("c_id")))
    d = d.select("doc_id", "th", "cs", words(F.col("text")).alias("w"))
    seg = F.expr("transform(cs, c -> struct(c.gid as gid, c.diag as diag, c.win as win, slice(w, greatest(c.diag, 0) + 1, c.len - greatest(-c.diag, 0)) as seg))")
    d = d.select("doc_id", "th", F.explode(seg).alias("c")).select("doc_id", "th", "c.*")
    d = met(d, items.select("gid", "iw", "ids"), ["gid"], MAX_DOCS, ["th", "diag"])
    d = d.withColumn("m", F.zip_with("seg", F.expr("slice(iw, greatest(-diag, 0) + 1, size(iw))"), lambda a, b: F.coalesce(F.translate(a, UPPER, LOWER) == b, F.lit(False))))
    d = d.withColumn("starts", F.expr("case when size(m) >= win then filter(sequence(0, size(m) - win), s -> forall(slice(m, s + 1, win), x -> x)) else cast(array() as array<int>) end"))
    d = d.where("size(starts) > 0").select("doc_id", "th", "ids", F.expr("array_distinct(flatten(transform(starts, s -> sequence(greatest(diag, 0) + s, greatest(diag, 0) + s + win - 1))))").alias("at")).distinct()
    exact = d.groupBy("doc_id", "th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"),
    )
    none = F.lit(None)
    both = exact.withColumn("n_near", none.cast("long")).unionByName(near.withColumns({"n_hit": none.cast("long"), "ids": none.cast("array<string>")}))
    out = stage(both.groupBy("doc_id", "th").agg(*[F.max(c).alias(c) for c in ("n_hit", "ids", "n_near")]), "matches")
    drop(hits, cand, rows, anchors)
    return out


def _keyed(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """docs with the hash of the text, found with its keys renamed, and the condition that joins them; no name clashes."""
    own, f_id, f_th = unused([*docs.columns, *found.columns], "_th", "_f_id", "_f_th")
    renamed = found.withColumnsRenamed({"doc_id": f_id, "th": f_th})
    return docs.withColumn(own, F.xxhash64("text")), renamed, (F.col(own) == F.col(f_th)) & F.col("doc_id").eqNullSafe(F.col(f_id))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of an item; columns as before."""
    d, found, same = _keyed(docs, stage(contamination(docs, benchmark).where("n_hit > 0").select("doc_id", "th"), "leaks"))
    return d.join(_small(found, MAX_DOCS), same, "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    rows, found, same = _keyed(docs.select("doc_id", "text", F.size(words(F.col("text"))).cast("long").alias("n_words")), found)
    out = rows.join(found, same, "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


_W = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW}, {_W}) as w from documents),
b as (select item_id::varchar as id, regexp_extract_all({_LOW}, {_W}) as w from benchmark),
bw as (select distinct id, least(len(w), 10) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as k
       from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
dw as (select r, n, s, array_to_string(w[s:s + n - 1], ' ') as k
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from bw) where len(w) >= n)),
m as (select distinct r, s, n, id from dw join bw using (n, k)),
p as (select r, count(distinct s + o) as n_hit from (select r, s, unnest(range(n)) as o from m) group by r),
i as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, id from m) group by r),
tok as (select r, unnest(range(len(w))) as pos, lower(unnest(w)) as key from d),
it as (select distinct w, least(len(w), 10) as win from b where len(w) > 0 and id is not null),
bt as (select w, win, unnest(range(len(w))) as off, lower(unnest(w)) as key from it),
cnt as (select key, count(*) as c from tok where key in (select key from bt) group by 1),
bc as (select w, win, off, key, coalesce(c, 0) as c from bt left join cnt using (key)),
sp as (select w, win, unnest(range(len(w) - win + 1)) as s from it),
rk as (select w, off, key, row_number() over (partition by w, s order by c, off, key) as k from sp join bc using (w, win) where off >= s and off < s + win),
an as (select distinct w, off, key from rk where k <= 2),
hi as (select r, w, off, pos - off as diag from tok join an using (key)),
nr as (select r, w, off <> lag(off) over x as other, diag - lag(diag) over x as gap from hi window x as (partition by r, w order by diag, off)),
ne as (select r, count(distinct w) as n_near from nr where other and gap <= {SLOP} group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join p using (r) left join i using (r) left join ne using (r)
"""
