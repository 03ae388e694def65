"""Harvested records: scans, sinks, parsing, links, and the paged harvest."""

from __future__ import annotations

import re
import urllib.parse
import urllib.request
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

RECORD = "id string, xml string, file string, status string"
# The ten Dublin Core elements that are read.
ELEMENTS = ("title", "creator", "contributor", "date", "description", "subject", "language", "rights", "publisher", "type")
# Extensions of a full text.
EXTENSIONS = ("pdf", "doc", "docx", "odt", "txt", "html", "htm", "epub")
REFERENCE = "ref_id string, doc_id string, doc_title string, repo string, ref_num int, text string, year string, authors array<string>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped; a missing path is an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path.split("*")[0])
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def records(spark: SparkSession, root: str) -> DataFrame:
    """All repositories' records under ``root``/repo=<name>/metadata.jsonl."""
    return read_jsonl(spark, root, RECORD + ", repo string")


def replace_dir(spark: SparkSession, staging: str, path: str) -> None:
    """Swap the finished folder ``staging`` for ``path``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, new, gone = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, staging, f"{path}.old-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(conf)
    had = fs.exists(target)
    if had and not fs.rename(target, gone):
        raise OSError(f"could not move {path}")
    if not fs.rename(new, target):
        if had:
            fs.rename(gone, target)
        raise OSError(f"could not swap {path}")
    if had:
        fs.delete(gone, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the target, then swap names: a failed write leaves the old table."""
    staging = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    replace_dir(df.sparkSession, staging, path)


def append_new(known: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows of ``found`` whose key isn't known; of repeats one stays.  First write wins."""
    return found.dropDuplicates(list(keys)).join(known.select(*keys).distinct(), list(keys), "left_anti")


def parse_dublin_core(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``df`` with one column per Dublin Core element: all values stripped and joined by `` ; ``, '' where there is none or
    the XML can't be parsed."""
    schema = "struct<" + ", ".join(f"{e}: string" for e in ELEMENTS) + ">"

    @F.pandas_udf(schema)
    def parse(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            got: dict[str, list[str]] = {e: [] for e in ELEMENTS}
            try:
                for node in ET.fromstring(x or "").iter():
                    name = str(node.tag).rpartition("}")[2]
                    if name in got and (text := "".join(node.itertext()).strip()):
                        got[name].append(text)
            except ET.ParseError:
                got = {e: [] for e in ELEMENTS}
            rows.append({e: " ; ".join(v) for e, v in got.items()})
        return pd.DataFrame(rows, columns=list(ELEMENTS))

    return df.withColumn("_dc", parse(F.regexp_replace(xml, r"<(/?)[A-Za-z_][\w.-]*:", "<$1"))).select("*", "_dc.*").drop("_dc")


def build_corpus(raw: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Documents from records (repo, id, xml, file): cleaned names and keywords, type, year, and with ``texts`` (name, text)
    by the file's base name or the SHA-256 of the XML: conclusions and references."""
    from ..functions.names import clean_names

    d = parse_dublin_core(raw.select("repo", "id", "file", "xml"))
    if texts is not None:
        t = texts.select("name", "text")
        base = F.regexp_replace(F.regexp_extract(T.nz(F.col("file")), r"([^/]*)$", 1), r"\.[^.]*$", "")
        d = d.withColumn("_base", base).withColumn("_sha", F.sha2("xml", 256))
        d = d.join(t.select(F.col("name").alias("_base"), F.col("text").alias("_t1")), "_base", "left").join(t.select(F.col("name").alias("_sha"), F.col("text").alias("_t2")), "_sha", "left")
        d = d.withColumn("fulltext", F.coalesce("_t1", "_t2", F.lit(""))).drop("_base", "_sha", "_t1", "_t2")
    else:
        d = d.withColumn("fulltext", F.lit(""))
    entries = F.transform(T.split_references(T.reference_section(F.col("fulltext"))), lambda x, i: F.struct(F.concat(T.doc_key(F.col("repo"), F.col("id")), F.lit("#"), (i + 1).cast("string")).alias("ref_id"), (i + 1).alias("ref_num"), x.alias("text"), F.regexp_extract(x, r"\b((?:19\d\d|20[0-2]\d))\b", 1).alias("year"), clean_names(F.regexp_extract(x, r"(?s)^(.*?)(?:\b\d{4}|$)", 1)).alias("authors")))
    d = d.select("repo", "id", "title", "creator", "contributor", "date", "description", "subject", "language", "publisher", T.doc_type(F.col("type")).alias("type"), clean_names(F.col("creator")).alias("creators"), clean_names(F.col("contributor")).alias("contributors"), T.keywords(F.col("subject")).alias("keywords"), T.year_of(F.col("date")).alias("year"), T.conclusions(F.col("fulltext")).alias("conclusions"), entries.alias("references"), "file", (F.trim("fulltext") != "").alias("has_fulltext"))
    return d.withColumn("reference_count", F.size("references"))


def resolve_keywords(docs: DataFrame, catalog: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``keywords`` whose ``cti/<code>`` entries are named by ``catalog`` (code, name) or dropped."""
    x = docs.select(*key, F.posexplode_outer("keywords").alias("pos", "word")).withColumn("code", F.when(F.col("word").startswith("cti/"), F.substring("word", 5, 100)))
    known = catalog.where(F.length("code").isin(1, 2, 4, 6)).groupBy("code").agg(F.max("name").alias("name"))
    x = x.join(known, "code", "left").withColumn("word", F.when(F.col("code").isNull(), F.col("word")).otherwise(F.col("name")))
    again = x.groupBy(*key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda s: s["word"])).alias("keywords"))
    return docs.drop("keywords").join(again, list(key))


def document_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, link): the first link of each page with a full text's extension, without query; no privacy or licence pages;
    relative ones resolved against the page."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?i)href\s*=\s*[\"']([^\"'?#]+)"), F.lit(1))
    good = F.filter(hrefs, lambda x: x.rlike(rf"(?i)\.({'|'.join(EXTENSIONS)})$") & ~x.rlike(r"(?i)privacidad|privacy|licen[cs]"))
    first = F.get(good, F.lit(0))
    site, folder = F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]+", 0), F.regexp_extract(F.col(url), r"^([a-z]+://[^?#]*/)", 1)
    full = F.when(first.rlike(r"^[a-z]+://"), first).when(first.startswith("/"), F.concat(site, first)).otherwise(F.concat(folder, first))
    return pages.select(F.col(key).alias("key"), full.alias("link")).where("link is not null")


# --------------------------------------------------------------------------- harvest
def resumption_url(base: str, token: str) -> str:
    return base.split("?")[0] + "?verb=ListRecords&resumptionToken=" + urllib.parse.quote(token, safe="")


def fetch(url: str, timeout: int = 180) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode("utf-8", "replace")


def harvest_pages(endpoint: str, since: str | None = None, get: Callable[[str], str] = fetch, max_pages: int = 10_000) -> Iterator[tuple[str, str]]:
    """(id, record XML) of an OAI-PMH endpoint, page after page, up to an error element, an empty body or the last token.
    A page that can't be fetched or parsed raises after the records of the pages before it."""
    url = endpoint
    if since and "from=" not in url:
        url += ("&" if "?" in url else "?") + "from=" + since[:10]
    for _ in range(max_pages):
        body = get(url)
        if not body.strip():
            return
        root = ET.fromstring(body)
        if root.find(".//{*}error") is not None:
            return
        for r in root.iter():
            if str(r.tag).rpartition("}")[2] == "record":
                name = next((n.text for n in r.iter() if str(n.tag).rpartition("}")[2] == "identifier" and n.text), None)
                if name:
                    yield name.strip(), ET.tostring(r, encoding="unicode")
        token = next((n.text for n in root.iter() if str(n.tag).rpartition("}")[2] == "resumptionToken"), None)
        if not token or not token.strip():
            return
        url = resumption_url(endpoint, token.strip())


def harvest_all(endpoints: DataFrame, get: Callable[[str], str] = fetch) -> DataFrame:
    """(repo, id, xml, error) of endpoints (repo, endpoint, since), one repository a task; one that fails doesn't stop the
    others: the records it gave come, and then a row with the error and no id."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                held: list[tuple] = []
                try:
                    for name, xml in harvest_pages(r.endpoint, r.since, get):
                        held.append((r.repo, name, xml, None))
                        if len(held) >= 1000:
                            yield pd.DataFrame(held, columns=["repo", "id", "xml", "error"])
                            held = []
                except Exception as e:  # noqa: BLE001  goes into the error column
                    held.append((r.repo, None, None, repr(e)))
                if held:
                    yield pd.DataFrame(held, columns=["repo", "id", "xml", "error"])

    return endpoints.select("repo", "endpoint", "since").repartition("repo").mapInPandas(run, "repo string, id string, xml string, error string")


def harvest_into(spark: SparkSession, endpoints: dict[str, str], data: str, now: str, incremental: bool = True, get: Callable[[str], str] = fetch) -> DataFrame:
    """Harvest repositories (name: endpoint) and append the records not yet in ``data``; (repo, new, error) of each.

    The day of each repository's last harvest without an error is kept in ``data``/_cursors; with ``incremental`` a
    harvest begins there.  One that fails keeps its cursor and the records it gave."""
    from ..plans.shared import save

    state = f"{data}/_cursors"
    wanted = spark.createDataFrame(list(endpoints.items()), "repo string, endpoint string")
    known = read_jsonl(spark, state, "repo string, since string")
    ends = save(wanted.join(known, "repo", "left").select("repo", "endpoint", F.col("since") if incremental else F.lit(None).cast("string").alias("since")), "endpoints")
    got = save(harvest_all(ends, get), "harvest")
    old = records(spark, data).select("repo", "id").where("id is not null")
    new = save(append_new(old, got.where("id is not null").select("repo", "id", "xml", F.lit(None).cast("string").alias("file"), F.lit("harvested").alias("status")), ("repo", "id")), "new-records")
    new.write.partitionBy("repo").mode("append").json(data)
    cursors = next_cursor(ends, got, now).where("since is not null").select("repo", "since")
    kept = save(known.join(wanted.select("repo"), "repo", "left_anti").unionByName(cursors), "cursors")
    kept.write.mode("overwrite").json(state)
    told = got.groupBy("repo").agg(F.max("error").alias("error"))
    return ends.select("repo").join(new.groupBy("repo").agg(F.count(F.lit(1)).alias("new")), "repo", "left").join(told, "repo", "left").select("repo", F.coalesce("new", F.lit(0)).alias("new"), "error").orderBy("repo")


def next_cursor(endpoints: DataFrame, harvested: DataFrame, now: str) -> DataFrame:
    """(repo, endpoint, since) for the next harvest: ``now`` for repositories without an error, else what it was."""
    failed = harvested.where("error is not null").select("repo").distinct().withColumn("failed", F.lit(True))
    return endpoints.join(failed, "repo", "left").select("repo", "endpoint", F.when(F.col("failed"), F.col("since")).otherwise(F.lit(now)).alias("since"))


def extract_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the files under ``path``: plain text and simple HTML; other formats need a converter and give ''."""

    @F.pandas_udf("string")
    def read(names: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for n, c in zip(names, contents, strict=True):
            text = bytes(c).decode("utf-8", "replace")
            ext = n.rpartition(".")[2].lower()
            out.append(text if ext == "txt" else re.sub(r"(?s)<(script|style).*?</\1>|<[^>]+>", " ", text) if ext in ("html", "htm") else "")
        return pd.Series(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), read(name, F.col("content")).alias("text"))
