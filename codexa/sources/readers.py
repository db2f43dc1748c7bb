"""Readers: papers and corpus JSON, article XML, BibTeX, reference JSON, lookup JSON, CSV tables, file listings. Schemas are explicit, text is never NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions import text as T
from codexa.numbering import positions

from .articles import articles_xml, parse_articles  # noqa: F401  re-exported
from .bibtex import bibtex  # noqa: F401
from .documents import in_lines, is_list
from .schemas import AUTHOR_FIELDS, CACHE, PAPER, PAPER_FIELDS, REFERENCE, REFERENCE_FIELDS, TOPIC


def _filled(df: DataFrame) -> DataFrame:
    return df.na.fill("")


_SEARCH = "mindate string, maxdate string, years_back int, retmax int, narrowed_by_affiliation boolean, esearch_term string, esearch_matched int, pmids_returned int, truncated boolean, fetched int, verified int"


def _nested(ddl: str) -> str:
    """Top-level fields as those of a struct."""
    return re.sub(r"(^|, )(\w+) (?=\w)", r"\1\2: ", ddl)


def _boxed(spark: SparkSession, path: str, more: str) -> DataFrame:
    """Files of JSON as Spark's parser reads them, token by token: an object gives its papers and the fields in `more`; each object of a bare list is a paper of its own."""
    schema = f"papers array<struct<{_nested(PAPER)}>>, {more}, {PAPER}"
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("place", F.monotonically_increasing_id())


def papers_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, provenance) of a bare list or an envelope {search, papers}; a bare list has no provenance. ord: the place in the file, from 0 and gapless within one file.

    No file stands in memory as text. An object with neither papers nor search is a paper itself. A document of whole records on its lines, which may stand in several files of a folder, is read by
    as many tasks as it has blocks; other layouts by one task for each file.
    """
    lined = in_lines(spark, path, PAPER, ("papers",), f"search struct<{_nested(_SEARCH)}>")
    if lined:
        papers, about = lined
        about = spark.createDataFrame([], f"search struct<{_nested(_SEARCH)}>") if about is None else about
        return _filled(papers.withColumn("ord", F.col("ord").cast("int"))), _provenance(about)
    rows = _boxed(spark, path, f"search struct<{_nested(_SEARCH)}>")
    envelope = F.col("papers").isNotNull() | F.col("search").isNotNull()
    fields = [f.split()[0] for f in PAPER_FIELDS]
    inside = rows.where(envelope).select("place", F.posexplode("papers").alias("at", "p")).select("place", "at", "p.*")
    alone = rows.where(~envelope).select("place", F.lit(0).alias("at"), *fields)
    both = inside.unionByName(alone)
    papers = positions(both, "place", "at", name="ord").drop("place", "at").select(F.col("ord").cast("int").alias("ord"), *fields)
    return _filled(papers), _provenance(rows)


def _provenance(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("search").isNotNull()).select("search.*").withColumn("rejected", F.col("fetched") - F.col("verified"))


def corpus_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, one-row metadata) of a profile corpus, which is one JSON object; a list is refused."""
    meta = "schema_version int, generated_at string, position_filtered boolean, fallback_fired boolean, query struct<term: string, mindate: string, maxdate: string, years_back: int, retmax: int, esearch_count: int, pmids_returned: int, truncated: boolean>, identity struct<author_name: string, orcid: string, affiliation_keywords: array<string>, email_domains: array<string>>, counts struct<fetched: int, verified: int, name_only: int, rejected: int, by_evidence: map<string,int>>"
    lined = in_lines(spark, path, PAPER, ("papers",), meta)
    if lined:
        papers, about = lined
        if about is None:
            raise ValueError("a corpus file holds one JSON object with papers")
        return _filled(papers.withColumn("ord", F.col("ord").cast("int"))), about
    rows = _boxed(spark, path, meta)
    names = [c for c in rows.columns if c not in ("papers", "place", *PAPER_FIELDS)]
    if not rows.where("papers is null").isEmpty():
        raise ValueError("a corpus file holds one JSON object with papers")
    papers, _ = papers_json(spark, path)
    return papers, rows.select(*names)


def bylines(papers: DataFrame) -> DataFrame:
    """One row for each author with idx from 0."""
    return papers.select("pmid", F.posexplode("authors").alias("idx", "a")).select("pmid", "idx", *[F.col(f"a.{f}").alias(f) for f in AUTHOR_FIELDS])


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def refs_json(spark: SparkSession, path: str) -> DataFrame:
    """References of a list, or of an object with references or entries: unknown fields are dropped, values become text, identifiers lose labels and addresses, the key defaults to ref{i}."""
    if lined := in_lines(spark, path, REFERENCE, ("references", "entries")):
        return _reference(lined[0])
    kind = "array<struct<" + _nested(REFERENCE) + ">>"
    rows = spark.read.schema(f"references {kind}, entries {kind}, {REFERENCE}").option("multiLine", True).json(path).withColumn("place", F.monotonically_increasing_id())
    boxed = F.coalesce("references", "entries")
    inside = rows.where(boxed.isNotNull()).select("place", F.posexplode(boxed).alias("at", "r")).select("place", "at", "r.*")
    alone = rows.where("references is null and entries is null").select("place", F.lit(0).alias("at"), *REFERENCE_FIELDS)
    return _reference(positions(inside.unionByName(alone), "place", "at", name="ord"))


def _reference(found: DataFrame) -> DataFrame:
    get = lambda f: T.text(F.col(f))
    made = {f: get(f) for f in REFERENCE_FIELDS} | {
        "key": _first(get("key"), F.concat(F.lit("ref"), (F.col("ord") + 1).cast("string"))), "entry_type": _first(get("entry_type"), F.lit("article")), "doi": T.clean_doi(F.col("doi")), "pmid": T.clean_pmid(F.col("pmid")),
    }
    return found.select(F.col("ord").cast("int").alias("ord"), *[v.alias(f) for f, v in made.items()])


def _record(df: DataFrame, c: str, schema: str, key: str | None) -> tuple[DataFrame, Column]:
    """The parsed answers as m, and why one cannot be used: a malformed or missing answer fails the entry that asked for it, never the job."""
    parsed = F.from_json(c, f"{schema}, _malformed string", {"columnNameOfCorruptRecord": "_malformed"})
    m = df.select(parsed.alias("m"), F.col(c).isNull().alias("none"), (F.col(key) if key else F.lit(None)).cast("string").alias("asked"))
    problem = F.when(F.col("none"), "no answer").when(F.col("m").isNull() | F.col("m._malformed").isNotNull(), "malformed answer")
    return m, problem


def crossref_json(df: DataFrame, c: str = "value", key: str | None = None) -> DataFrame:
    """Works JSON -> canonical records with lookup_error (NULL: none). key: the column with the DOI that was asked for, which names records whose answer is missing or malformed."""
    schema = "DOI string, title array<string>, author array<struct<family: string, given: string, name: string>>, issued struct<`date-parts`: array<array<string>>>, `container-title` array<string>, volume string, issue string, page string, type string"
    m, problem = _record(df, c, schema, key)
    names = F.filter(F.transform("m.author", lambda a: _first(T.text(a["family"]), T.text(a["name"]))), lambda n: n != "")
    head = lambda x: T.text(F.get(x, 0))
    made = {
        "doi": _first(T.text(F.col("m.DOI")), T.text(F.col("asked"))), "title": head(F.col("m.title")), "first_author": head(names), "all_authors": F.coalesce(names, F.array().cast("array<string>")),
        "year": T.text(F.get(F.get(F.col("m.issued.date-parts"), 0), 0)), "journal": head(F.col("m.container-title")), "volume": T.text(F.col("m.volume")), "issue": T.text(F.col("m.issue")),
        "pages": T.text(F.col("m.page")), "type": T.text(F.col("m.type")), "lookup_error": problem,
    }
    return m.select(*[v.alias(k) for k, v in made.items()])


def summary_json(df: DataFrame, c: str = "value", key: str | None = None) -> DataFrame:
    """Summary JSON -> canonical records with lookup_error (NULL: none). key: the column with the PMID that was asked for."""
    schema = "uid string, title string, authors array<struct<name: string>>, articleids array<struct<idtype: string, value: string>>, pubdate string, fulljournalname string, source string, volume string, issue string, pages string"
    m, problem = _record(df, c, schema, key)
    names = F.filter(F.transform("m.authors", lambda a: T.text(a["name"])), lambda n: n != "")
    doi = F.get(F.filter("m.articleids", lambda a: a["idtype"] == "doi"), 0)["value"]
    made = {
        "pmid": _first(T.text(F.col("m.uid")), T.text(F.col("asked"))), "doi": T.text(doi), "title": T.text(F.col("m.title")), "first_author": T.text(F.get(names, 0)),
        "all_authors": F.coalesce(names, F.array().cast("array<string>")), "year": F.substring_index(T.text(F.col("m.pubdate")), " ", 1),
        "journal": _first(T.text(F.col("m.fulljournalname")), T.text(F.col("m.source"))), "volume": T.text(F.col("m.volume")), "issue": T.text(F.col("m.issue")), "pages": T.text(F.col("m.pages")), "lookup_error": problem,
    }
    return m.select(*[v.alias(k) for k, v in made.items()])


def topic_records(spark: SparkSession, folder: str, name: str = "topic_extraction") -> DataFrame:
    """Topic records of a folder: those in JSON if there is such a file, else those in CSV, else none. Spark's readers pass over names that begin with an underscore."""
    for kind in ("json", "csv"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{kind}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return topics(spark, f"{folder}/{name}.{kind}")
    return spark.createDataFrame([], TOPIC)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic records of JSON (a list in any layout, or lines) or CSV."""
    if not path.endswith("json"):
        return spark.read.schema(TOPIC).option("header", True).csv(path)
    if lined := in_lines(spark, path, TOPIC, ordered=False):
        return lined[0]
    return spark.read.schema(TOPIC).option("multiLine", is_list(spark, path)).json(path)


def papers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exported papers; rows without an id are skipped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return _filled(df.toDF(*[c.strip().lstrip("\ufeff").lower().replace(" ", "_") for c in df.columns])).where("trim(pmid) <> ''")


def cache_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("mtime"))


def latest(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))
