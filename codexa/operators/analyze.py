"""Author records, person x paper matrix, roster by name, topics, text corpus and the check that a PDF is the paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.functions import text as T
from codexa.functions.markup import unescape
from codexa.numbering import positions

# Words that say nothing about a title.
STOP = "with from that this into using based study analysis effect effects role roles and the for its via are was were between relationship".split()
# Headings of sections.
HEADINGS = ["abstract", "introduction", "background", "results", "methods", "materials and methods", "methodology", "discussion", "conclusion", "conclusions", "references", "acknowledgements", "acknowledgments"]


def author_records(papers: DataFrame, detailed: DataFrame) -> DataFrame:
    """papers(pmid, ord, authors_str) with the authors of the last detailed record of the id, or names split from authors_str without flags."""
    last = detailed.groupBy("pmid").agg(F.max_by("authors", "ord").alias("authors"))
    kind = detailed.schema["authors"].dataType.elementType
    bare = F.transform(T.split_authors(F.col("authors_str")), lambda n: F.struct(*[n.alias("name") if f.name == "name" else (F.lit(False) if f.dataType.typeName() == "boolean" else F.lit("")).cast(f.dataType).alias(f.name) for f in kind.fields]))
    return papers.join(last, "pmid", "left").withColumn("authors", F.coalesce("authors", bare))


def newest_in(files: DataFrame, folder: str = "suspect") -> DataFrame:
    """files(path, mtime): the newest file of each pmid inside a folder of that name."""
    return _newest(files.where(F.contains("path", F.lit(f"/{folder}/"))))


def pdf_report(papers: DataFrame, files: DataFrame) -> DataFrame:
    """papers(pmid, title, pub_date, doi, pmc_id, pdf_status, validation_reason) with the source named in the status, the accepted file (path, size) and the
    newest suspect one; a file that is not there gives empty text and no size. Titles are cut to 200 characters, as the report prints them."""
    size = files.select(F.col("path").alias("pdf_path"), F.col("size").alias("file_size_bytes"))
    main = newest_file(files).withColumnRenamed("path", "pdf_path").join(size, "pdf_path")
    aside = newest_in(files).withColumnRenamed("path", "suspect_path")
    out = papers.join(main, "pmid", "left").join(aside, "pmid", "left")
    return out.select(
        "pmid", F.left(T.text(F.col("title")), F.lit(200)).alias("title"), "pub_date", "doi", "pmc_id", T.text(F.col("pdf_status")).alias("pdf_status"), T.trailing_source(F.col("pdf_status")).alias("pdf_source"),
        "validation_reason", T.text(F.col("pdf_path")).alias("pdf_path"), "file_size_bytes", T.text(F.col("suspect_path")).alias("suspect_path"),
    )


def explode_authors(records: DataFrame, date: str = "pubdate") -> DataFrame:
    n = F.size("authors")
    return records.select("pmid", date, F.posexplode("authors").alias("idx", "a"), n.alias("n_authors")).where("a.name <> ''").select("pmid", date, (F.col("idx") + 1).alias("index"), "a.*", (F.col("idx") == 0).alias("is_first"), (F.col("idx") == F.col("n_authors") - 1).alias("is_last"))


def matrix_long(entries: DataFrame) -> DataFrame:
    """name, pmid, label; the last entry of a person on a paper wins."""
    label = T.role_label(F.col("is_first"), F.col("is_last"), F.col("equal_contrib"), F.col("is_corresponding"), F.col("index"))
    return entries.withColumn("label", label).groupBy("name", "pmid").agg(F.max_by("label", "index").alias("label"))


def matrix_wide(long: DataFrame, pmids: list[str]) -> DataFrame:
    return long.groupBy("name").pivot("pmid", pmids).agg(F.first("label")).na.fill("")


def roster_by_name(entries: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Analyze roster: one row for each exact trimmed name with stratum, years and censoring by the data's own window; 1900 and before counts as undated.
    No row for empty and excluded names (case aside), whose records still widen the window."""
    away = ["", *(x.strip().lower() for x in exclude)]
    e = entries.withColumns({"name": F.trim("name"), "year": F.substring("date_iso", 1, 4).cast("int")})
    dated = e.where(F.col("year") > 1900)
    span = dated.agg(F.min("year").alias("w0"), F.max("year").alias("w1"))
    years = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("year"))))
    p = dated.where(~F.lower("name").isin(away)).groupBy("name").agg(
        F.count("*").alias("n"), F.count_if("is_first").alias("n_first"), F.count_if("is_last").alias("n_last"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min("date_iso").alias("first_date"), years(F.lit(True)).alias("years"), years(F.col("is_first")).alias("lead_years"), years(F.col("equal_contrib")).alias("equal_years"),
    )
    p = p.withColumn("stratum", F.when(F.col("n_last") >= 1, "D").when(F.col("n_first") >= 1, "A").when(F.col("n") >= 2, "B").otherwise("C"))
    return p.join(F.broadcast(span)).withColumns({"left_censored": F.col("first_year") <= F.col("w0"), "right_censored": F.col("last_year") >= F.col("w1") - 1}).drop("w0", "w1")


def roster_counts(entries: DataFrame, roster: DataFrame) -> DataFrame:
    """One row: people, those of strata C and D, who get no row in the timeline, and undated records."""
    undated = entries.where(F.substring("date_iso", 1, 4).cast("int") <= 1900).agg(F.count_distinct("pmid").alias("n_undated"))
    n = roster.agg(F.count("*").alias("n_people"), *[F.count_if(F.col("stratum") == s).alias(f"omitted_{s.lower()}") for s in "CD"])
    return n.join(F.broadcast(undated))


def topic_counts(topics: DataFrame, buckets: list[str]) -> DataFrame:
    spine = topics.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    n = topics.groupBy(F.col("primary_bucket").alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def topic_years(topics: DataFrame) -> DataFrame:
    """bucket, year, n; primary and secondary both count."""
    rows = topics.select("year", F.explode(F.array("primary_bucket", "secondary_bucket")).alias("bucket"))
    return rows.where("bucket is not null and bucket <> ''").groupBy("bucket", "year").agg(F.count("*").alias("n"))


def pdf_matches(doi: Column, title: Column, body: Column, least: float = 0.45) -> Column:
    """Reason why a PDF's text is, or is not, the paper. Character references in either are decoded first."""
    title, body = unescape(title), unescape(body)
    flat = lambda c: F.trim(F.regexp_replace(F.lower(T.text(c)), "[^a-z0-9]+", " "))
    squeezed = lambda c: F.regexp_replace(F.lower(T.text(c)), "\\s+", "")
    key = T.normalize_doi(doi)
    words = T.significant_tokens(title, STOP)
    there = F.array_distinct(F.split(flat(body), " "))
    overlap = F.try_divide(F.size(F.array_intersect(words, there)).cast("double"), F.size(words).cast("double"))
    return (
        F.when(F.trim(T.text(body)) == "", "no_text").when((key != "") & (F.contains(F.lower(body), key) | F.contains(squeezed(body), squeezed(key))), "doi")
        .when((flat(title) != "") & F.contains(flat(body), flat(title)), "title").when(overlap >= least, "tokens").otherwise("reject")
    )


def text_corpus(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """papers ⟕ texts(pmid, body, note): opening of the discussion, end of the introduction."""
    j = papers.join(texts, "pmid", "left")
    return j.withColumns({"intro_last": T.last_paragraph(T.section(F.col("body"), "introduction", HEADINGS)), "disc_first": T.first_paragraph(T.section(F.col("body"), "discussion", HEADINGS)), "pdf_chars": F.length("body")})


def newest_file(files: DataFrame) -> DataFrame:
    """files(path, mtime) named {pmid}_...: the newest of each pmid outside suspect/."""
    return _newest(files.where(~F.contains("path", F.lit("/suspect/"))))


def _newest(files: DataFrame) -> DataFrame:
    pmid = F.split(F.substring_index("path", "/", -1), "_")[0]
    return files.groupBy(pmid.alias("pmid")).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def truncated_search(found: DataFrame, most: int = 500) -> DataFrame:
    """matched, returned and truncated of a capped search; the cap is the feature."""
    n = found.agg(F.count("*").alias("matched"))
    return n.select("matched", F.least("matched", F.lit(most)).alias("returned"), (F.col("matched") > most).alias("truncated"))


def search_window(now: Column, years_back: int) -> Column:
    """mindate and maxdate of a search that looks back, a year being 365 days; today is a parameter."""
    return F.struct(F.date_format(F.date_sub(now, 365 * years_back), "yyyy/MM/dd").alias("mindate"), F.date_format(now, "yyyy/MM/dd").alias("maxdate"))


def search_page(found: DataFrame, order: list[str], most: int = 500, dates: tuple[str, str] | None = None, keep: Column | None = None) -> DataFrame:
    """The first `most` rows (the cap is the feature) of those dated within dates and kept by a narrowing condition."""
    rows = found.where(F.col("date_iso").between(*dates)) if dates else found
    return (rows.where(keep) if keep is not None else rows).orderBy(*order).limit(most)


EXPORT = ["pmid", "title", "authors_str", "role", "journal", "pub_date", "volume", "issue", "pages", "doi", "pmc_id", "pdf_status", "abstract"]


def numbered(papers: DataFrame, *order) -> DataFrame:
    """Export projection: running number from 1, the columns of EXPORT (empty where papers has none) and an abstract cut to 500 characters."""
    have = set(papers.columns)
    cells = [(T.text(F.col(c).cast("string")) if c in have else F.lit("")).alias(c) for c in EXPORT[:-1]]
    cut = F.left(T.text(F.col("abstract")), F.lit(500)) if "abstract" in have else F.lit("")
    return positions(papers, *order).select((F.col("pos") + 1).alias("no"), *cells, cut.alias("abstract"))


def default_exclusions(pi_name: str, configured: list[str] = ()) -> list[str]:
    """Names without a row of their own in a timeline: the investigator, the empty name and what the operator configured, trimmed, each once."""
    return sorted({"", (pi_name or "").strip(), *(c.strip() for c in configured if c and c.strip())})


def search(found: DataFrame, narrow: Column | None, order: list, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Count first, then fetch: the rows of a search and one row (broad_matched, narrowed, matched, returned, truncated) on how they came about.

    If more than `most` rows match and there is a narrowing condition, only the rows it holds for count. The count is a scalar subquery of the same plan, so data decides
    the branch and nothing passes through the driver. Rows beyond `most` are not fetched (the cap is the feature), which `truncated` says.
    """
    wide = found.agg(F.count("*").alias("n")).scalar() > most if narrow is not None else F.lit(False)
    kept = found.where(~wide | F.coalesce(narrow, F.lit(False))) if narrow is not None else found
    hit = F.coalesce(narrow, F.lit(False)) if narrow is not None else F.lit(True)
    told = found.agg(F.count("*").alias("broad_matched"), F.count_if(hit).alias("inside"))
    told = told.withColumn("narrowed", F.lit(narrow is not None) & (F.col("broad_matched") > most)).withColumn("matched", F.when(F.col("narrowed"), F.col("inside")).otherwise(F.col("broad_matched")))
    told = told.select("broad_matched", "narrowed", "matched", F.least("matched", F.lit(most)).alias("returned"), (F.col("matched") > most).alias("truncated"))
    return kept.orderBy(*order).limit(most), told


def by_year_text(papers: DataFrame) -> DataFrame:
    """papers(pub_year, ord) numbered by the year as text, latest first, and their own order."""
    return positions(papers, F.desc("pub_year"), F.col("ord"), name="place")


def matrix_axes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns and rows of the person x paper matrix: papers by date and id, people from A to Z, both numbered."""
    papers = positions(entries.select("pmid", "pubdate").distinct(), "pubdate", "pmid", name="place")
    return papers, positions(entries.select("name").distinct(), "name", name="place")
