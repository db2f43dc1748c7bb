"""Quality rules with adaptive thresholds (operator 1). DataFrame functions only.

Method. Four rates of each document go into mergeable quantile sketches: histograms over log-linear buckets (exact below 256,
then 128 buckets for each power of two, relative error under 1 %). A sketch is a set of (bucket, count) rows, so sketches merge by adding
counts and the outcome does not depend on partitions or order. Sketches are kept for (lang, source), merged to lang and to
the whole corpus; a group with fewer than `min_group` documents uses the next larger sketch. The upper fence of each rate is
q75 + spread * max(q75 - q25 of the group, q75 - q25 of its parent sketch, 1); no cutoff is fixed. A rate that is a share (marks that are neither letters nor digits, repeated lines,
capitals) is over its fence if the count exceeds what the fence allows for a text of that length by more than three standard errors (of a count, at least of 1), so that
short texts are not rejected for one mark or line. A document with a rate over its fence is rejected. Documents that fail the base
rule are not sketched.

Defined cases. Null or blank text: no words, base_failed. Null lang or source: a group of its own. Repeated rows are judged one
by one and alike. Empty table: no rows. Further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_RE, split_words, stage, table, unused

#: rate -> (numerator, denominator, scale, whether it is a share, of which counts have an error)
RATES = {
    "mark_pm": ("n_marks", "word_chars", 1000, True),
    "dup_line_pm": ("n_dup_lines", "n_lines", 1000, True),
    "upper_pm": ("n_upper", "word_chars", 1000, True),
    "word_len": ("word_chars", "n_words", 100, False),
}
SPREAD, ERRORS, MIN_GROUP = 4, 3, 30
#: Rejected keys up to which they are broadcast; beyond, the planner shuffles.
MAX_KEYS = 500_000  # 16 bytes each
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def measure(docs: DataFrame) -> DataFrame:
    """docs with the columns MEASURES, base_failed and RATES, each from the whole text."""
    space = "' \\t\\n\\u000B\\f\\r'"
    d = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_w", split_words(F.col("_t")))
    d = d.withColumn("_b", F.length(F.bin(F.size("_w").cast("long"))))
    # windows of three words: hash in the high bits, position in the low bits, sorted; what meets there is compared again by whole hashes
    d = d.withColumn(
        "_k",
        F.expr("sort_array(transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(_w, i + 1), get(_w, i + 2)), _b) | i))"),
    )
    d = d.withColumn(
        "_q",
        F.expr("""sort_array(transform(transform(filter(_k, (x, i) -> shiftright(x, _b) = shiftright(get(_k, i + 1), _b)
                  or shiftright(x, _b) = shiftright(get(_k, i - 1), _b)), x -> cast(x & (shiftleft(1L, _b) - 1) as int)),
                  p -> struct(xxhash64(get(_w, p), get(_w, p + 1), get(_w, p + 2)) as h, p as p)))"""),
    )
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(_q, (x, i) -> x.h = get(_q, i + 1).h or x.h = get(_q, i - 1).h), x -> x.p))"))
    d = d.withColumn("_l", F.expr(f"filter(split(_t, '\\n', -1), x -> length(btrim(x, {space})) > 0)"))
    chars = F.length(F.regexp_replace("_t", SPACE_RE, ""))
    d = d.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(_p, (p, i) -> least(3, coalesce(get(_p, i + 1) - p, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", "\\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", "[\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]+", "")).cast("long").alias("n_marks"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.withColumns({
        name: F.coalesce(F.floor(F.try_divide(F.col(a) * scale, F.col(b))), F.lit(0)).cast("long")
        for name, (a, b, scale, _) in RATES.items()
    })


def bucket(v: Column) -> Column:
    shift = F.length(F.bin(v)) - 8
    return F.when(v < 256, v).otherwise(shift * 256 + F.call_function("shiftright", v, shift)).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest value that falls into bucket b."""
    shift = F.floor(b / 256).cast("int")
    return F.when(b < 256, b).otherwise(F.call_function("shiftleft", b % 256 + 1, shift) - 1).cast("long")


def _key(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"_{c}")


def sketches(measured: DataFrame) -> DataFrame:
    """Rows (level, _lang, _source, rate, bucket, n): the histogram of each group; levels 0 group, 1 language, 2 corpus."""
    rows = measured.where(~F.col("base_failed")).select(
        _key("lang"), _key("source"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r in RATES])).alias("x"),
    )
    fine = rows.groupBy("_lang", "_source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))
    return fine.groupBy("_lang", "_source", "rate", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, spread: int = SPREAD, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each (_lang, _source) in the sketches with a fence column for each rate."""
    levels = [
        sketch.withColumn("level", F.lit(0)),
        sketch.groupBy("_lang", "rate", "bucket").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(1), "_source": F.lit("*")}),
        sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).withColumns({"level": F.lit(2), "_source": F.lit("*"), "_lang": F.lit("*")}),
    ]
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2])
    by = W.partitionBy("level", "_lang", "_source", "rate")
    run = merged.withColumns({"upto": F.sum("n").over(by.orderBy("bucket")), "total": F.sum("n").over(by)})
    q = run.groupBy("level", "_lang", "_source", "rate").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("b25"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("b75"),
    ).select("level", "_lang", "_source", "rate", "total", bucket_top(F.col("b25")).alias("q25"), bucket_top(F.col("b75")).alias("q75"))
    q = q.withColumn("iqr", F.col("q75") - F.col("q25"))
    wide = q.groupBy("level", "_lang", "_source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("rate") == r, F.struct("q75", "iqr"))).alias(r) for r in RATES]
    )
    own, lang, whole = (wide.where(F.col("level") == i) for i in range(3))
    lang = lang.select("_lang", F.struct("total", *RATES).alias("l"))
    whole = whole.select("level", F.struct(*RATES).alias("g"))
    joined = own.join(lang, "_lang", "left").withColumn("level", F.lit(2)).join(whole, "level", "left")

    def fence(r: str) -> Column:
        of = lambda own, *parent: F.col(f"{own}.q75") + spread * F.greatest(*[F.col(f"{x}.iqr") for x in (own, *parent)], F.lit(1))
        pick = F.when(F.col("total") >= min_group, of(r, f"l.{r}")).when(F.col("l.total") >= min_group, of(f"l.{r}", f"g.{r}"))
        return pick.otherwise(of(f"g.{r}")).cast("long").alias(f"max_{r}")

    return joined.select("_lang", "_source", *map(fence, RATES))


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """measured with the fences and kept; a staged fences table is broadcast by the planner only if its size is small."""
    keyed = measured.withColumns({"_lang": _key("lang"), "_source": _key("source")})
    out = keyed.join(fences, ["_lang", "_source"], "left").drop("_lang", "_source")
    over = F.lit(False)
    for r, (count, of, scale, share) in RATES.items():
        allowed = F.col(f"max_{r}") * F.col(of) / F.lit(float(scale))
        above = F.col(count) > allowed + ERRORS * F.sqrt(F.greatest(allowed, F.lit(1.0))) if share else F.col(r) > F.col(f"max_{r}")
        over = over | F.coalesce(above, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame) -> DataFrame:
    """The verdict on each row of docs(doc_id, text, lang, source)."""
    m = stage(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "measures")
    fences = stage(thresholds(sketches(m)), "fences")
    return judge(m, fences)


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows, columns as before. Verdicts are found on narrow rows; only their keys meet the texts again."""
    own, bad_key, bad_id = unused(docs.columns, "_own", "_key", "_id")
    key = F.xxhash64("text", "lang", "source")
    core = docs.select("doc_id", "text", "lang", "source", key.alias("key"))
    m = stage(measure(core).drop("text"), "measures")
    out = judge(m, stage(thresholds(sketches(m)), "fences"))
    bad = stage(out.where(~F.col("kept")).select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct(), "rejected")
    bad = F.broadcast(bad) if bad.limit(MAX_KEYS + 1).count() <= MAX_KEYS else bad
    keyed = docs.withColumn(own, key)
    return keyed.join(bad, (F.col(own) == F.col(bad_key)) & F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti").select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[f"max_{r}" for r in RATES])


def _oracle() -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    integer = lambda a, b, k: f"coalesce(({a} * {k}) // nullif({b}, 0), 0)::bigint"
    rates = ", ".join(f"{integer(a, b, k)} as {r}" for r, (a, b, k, _) in RATES.items())
    rows = " union all ".join(f"select l, s, '{r}' as rate, {r} as v from m where not base_failed" for r in RATES)
    fences = ", ".join(f"max(case when rate = '{r}' then q75 end) as q_{r}, max(case when rate = '{r}' then q75 - q25 end) as i_{r}" for r in RATES)
    pick = ", ".join(
        f"case when a.total >= {MIN_GROUP} then a.q_{r} + {SPREAD} * greatest(a.i_{r}, b.i_{r}, 1) when b.total >= {MIN_GROUP} then b.q_{r} + {SPREAD} * greatest(b.i_{r}, c.i_{r}, 1) "
        f"else c.q_{r} + {SPREAD} * greatest(c.i_{r}, 1) end as max_{r}" for r in RATES
    )
    allowed = lambda r: f"(max_{r} * {RATES[r][1]})::double / {RATES[r][2]}"
    over = " or ".join(f"coalesce({c} > {allowed(r)} + {ERRORS} * sqrt(greatest({allowed(r)}, 1)), false)" if share else f"coalesce({r} > max_{r}, false)" for r, (c, _, _, share) in RATES.items())
    return f"""
with o as (select row_number() over () as r, doc_id, coalesce('=' || lang, '') as l, coalesce('=' || source, '') as s, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+') as ws, list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {space})) > 0) as ls from o),
g as (select r, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
rep as (select r, count(distinct i + k) as n_repeat_words from (select r, i, unnest([0, 1, 2]) as k from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1) group by r),
x as (select r, doc_id, l, s, len(ws)::bigint as n_words, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g'))::bigint as n_upper,
             length(regexp_replace(t, '[\\p{{L}}\\p{{N}} \\t\\n\\x0B\\f\\r]+', '', 'g'))::bigint as n_marks
      from w left join rep using (r)),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {rates} from x),
v as (select l, s, rate, case when v < 256 then v else (length(bin(v)) - 8) * 256 + (v >> (length(bin(v)) - 8)) end as b from ({rows})),
h as (select 0 as level, l, s, rate, b, count(*) as n from v group by all union all select 1, l, '*', rate, b, count(*) from v group by all
      union all select 2, '*', '*', rate, b, count(*) from v group by all),
c as (select *, sum(n) over (partition by level, l, s, rate order by b) as upto, sum(n) over (partition by level, l, s, rate) as total from h),
q as (select level, l, s, rate, max(total) as total, min(case when 4 * upto >= total then b end) as b25, min(case when 4 * upto >= 3 * total then b end) as b75 from c group by all),
t as (select level, l, s, rate, total, case when b25 < 256 then b25 else (((b25 % 256) + 1) << (b25 // 256)) - 1 end as q25,
             case when b75 < 256 then b75 else (((b75 % 256) + 1) << (b75 // 256)) - 1 end as q75 from q),
f as (select level, l, s, max(total) as total, {fences} from t group by all),
e as (select a.l, a.s, {pick} from f a left join f b on b.level = 1 and b.l = a.l left join f c on c.level = 2 where a.level = 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) as kept,
       {", ".join(f"max_{r}::bigint as max_{r}" for r in RATES)}
from m left join e on m.l = e.l and m.s = e.s
"""


ORACLE_SQL = _oracle()
