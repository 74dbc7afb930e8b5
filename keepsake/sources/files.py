"""Reading export folders.

A folder is listed and read by Spark; which parser a file gets is a column. Filters on the path prune
the listing, so a family reads its own files only.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions.text import strip

RAW = ["owner_id", "path", "content"]


def owner_from_path(folder: str = "owner") -> Column:
    """Owner named by a path part such as ``owner=ana``."""
    return F.regexp_extract(F.col("path"), rf"/{folder}=([^/]+)/", 1)


#: What a document has besides owner and path: see ``json_cuts``.
CUT = ["content", "part", "array", "base", "counts"]


def whole(raw: DataFrame) -> DataFrame:
    """Documents that were not cut."""
    return raw.withColumns({"part": F.lit(0), "array": F.lit(None).cast("string"), "base": F.lit(0).cast("long"),
                            "counts": F.lit(None).cast("map<string,bigint>")})


def counts_here(array: str | None) -> Column:
    """Whether the elements of an array (None: the root) count with this part: its own, or what stayed whole, with the first."""
    own = F.col("array").isNull() if array is None else F.col("array") == array
    return (F.col("part") == 0) | F.coalesce(own, F.lit(False))


def elements_before(array: str | None) -> Column:
    """Elements before this part, if the document was cut at this array (None: at its root)."""
    own = F.col("array").isNull() if array is None else F.col("array") == array
    return F.when(own, F.col("base")).otherwise(F.lit(0).cast("long"))


def read_whole(spark: SparkSession, root: str, glob: str, owner: Column | None = None, fits: Column | None = None,
               some: Column | None = None) -> DataFrame:
    """Files below a folder, one row each. Folders that cannot be read are skipped.

    ``fits`` is a test on the file's metadata, ``some`` one on its ``path``: files that fail are not read.
    """
    rows = (
        spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", glob).text(root, wholetext=True)
    )
    rows = (rows if fits is None else rows.filter(fits)).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rows = rows if some is None else rows.filter(some)
    return rows.select((owner if owner is not None else owner_from_path()).alias("owner_id"),
                       "path", "content")


def read_pieces(spark: SparkSession, root: str, glob: str, separator: str,
                owner: Column | None = None, some: Column | None = None) -> DataFrame:
    """Files cut at a separator while reading, so one large file spreads over many tasks. ``some`` is a test on the path."""
    rows = (
        spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", glob).option("lineSep", separator).text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
    rows = rows if some is None else rows.filter(some)
    return rows.select((owner if owner is not None else owner_from_path()).alias("owner_id"),
                       "path", "content", F.monotonically_increasing_id().alias("seq"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_export_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with a header, all columns text. A missing file gives None; a broken one fails."""
    if not exists(spark, path):
        return None
    df = (
        spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        .option("mode", "FAILFAST").csv(path)
    )
    return df.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn(
        "seq", F.monotonically_increasing_id())


def pick(df: DataFrame, *names: str) -> Column:
    """First non-blank of the candidate columns that exist."""
    have = [F.col(n) for n in names if n in df.columns]
    if not have:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(strip(c) != "", c) for c in have])


#: Bytes of the largest document that the variant type takes.
LARGEST_DOCUMENT = 128 << 20


def parsed(raw: DataFrame, largest: int = LARGEST_DOCUMENT) -> DataFrame:
    """Documents as ``doc``; text that is not JSON gives null there. A document too large to parse is an error, not a gap."""
    raw = raw if "base" in raw.columns else whole(raw)
    fits = F.when(F.octet_length("content") > largest, F.raise_error(F.concat(
        F.lit("document too large to parse, split it: "), F.coalesce("path", F.lit("unnamed")))).cast("string"))
    return raw.withColumn("doc", F.try_parse_json(F.coalesce(fits, F.col("content"))))


def rejected(raw: DataFrame) -> DataFrame:
    """How many files of an owner are not JSON. They are skipped, not fatal."""
    return parsed(raw).groupBy("owner_id").agg(
        F.count_if(F.col("doc").isNull()).alias("rejected"), F.count(F.lit(1)).alias("files"))


# --- Nested JSON ---------------------------------------------------------------------------------------

OBJECTS = (
    "owner_id string, path string, position bigint, keys array<string>, strings map<string,string>, "
    "numbers map<string,double>, details array<string>, head string"
)


def _below(doc, start: int) -> Iterator[tuple[int, dict]]:
    """Objects at any depth in reading order, numbered from ``start``; the last number of its 16 bits is shared by the rest."""
    stack, i = [doc], 0
    while stack:
        cur = stack.pop()
        if isinstance(cur, dict):
            yield start + min(i, 0xFFFF), cur
            i += 1
        if isinstance(cur, (dict, list)):
            stack.extend(reversed([v for v in (cur.values() if isinstance(cur, dict) else cur) if isinstance(v, (dict, list))]))


def _all_objects(doc, part: int, array: str | None, base: int) -> Iterator[tuple[int, dict]]:
    """Objects with a position that is the same whether the document was cut or not.

    It says which member of the root, which element of its array, and which object of the element. What surrounds
    the array of a cut document counts once, with its first part.
    """
    def elements(values: list, member: int) -> Iterator[tuple[int, dict]]:
        for e, v in enumerate(values):
            yield from _below(v, (member << 48) + ((base + e + 1) << 16))

    if isinstance(doc, list):
        yield from elements(doc, 0)
    elif isinstance(doc, dict):
        if part == 0:
            yield 0, doc
        for k, v in doc.items():
            member = 1 + zlib.crc32(k.encode("utf-8", "replace")) % 0x7FFE
            if isinstance(v, list):
                if part == 0 or k == array:
                    yield from elements(v, member)
            elif part == 0 and isinstance(v, dict):
                yield from _below(v, member << 48)


def _tree_nodes(doc, *_) -> Iterator[tuple[int, dict]]:
    roots = doc.get("roots") if isinstance(doc, dict) else None
    stack = list(reversed(list(roots.values()))) if isinstance(roots, dict) else []
    i = 0
    while stack:
        cur = stack.pop()
        if isinstance(cur, dict):
            yield i, cur
            i += 1
            children = cur.get("children")
            stack.extend(reversed(children) if isinstance(children, list) else [])


def _summary(obj: dict) -> dict:
    details = obj.get("details")
    named = [d.get("name") if isinstance(d.get("name"), str) else d.get("title")
             for d in details if isinstance(d, dict)] if isinstance(details, list) else []
    return {
        "keys": list(obj), "strings": {k: v for k, v in obj.items() if isinstance(v, str)},
        "numbers": {k: float(v) for k, v in obj.items()
                    if isinstance(v, (int, float)) and not isinstance(v, bool)},
        "details": [d for d in named if isinstance(d, str) and d],
        "head": json.dumps(obj, separators=(",", ":"), ensure_ascii=False)[:300],
    }


def in_slices(rows: Iterator, size: int = 4096) -> Iterator[list]:
    """Rows some thousand at a time, so a large file never stands in one frame."""
    while part := list(itertools.islice(rows, size)):
        yield part


def json_objects(raw: DataFrame, tree: bool = False) -> DataFrame:
    """Every object of a JSON document, at any depth, as one row.

    ``tree`` follows only ``roots`` and ``children``. Depth is unbounded, which column expressions
    cannot say, so the walk is a small Arrow-batched helper.
    """
    walk = _tree_nodes if tree else _all_objects
    columns = ["owner_id", "path", "content", "part", "array", "base"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def objects():
            for batch in batches:
                for owner, path, content, part, array, base in zip(*(batch[c] for c in columns)):
                    try:
                        doc = json.loads(content)
                    except (TypeError, ValueError):
                        continue
                    for i, o in walk(doc, part, array, base):
                        yield {"owner_id": owner, "path": path, "position": i, **_summary(o)}

        for rows in in_slices(objects()):
            yield pd.DataFrame(rows, columns=[
                "owner_id", "path", "position", "keys", "strings", "numbers", "details", "head"])

    return (raw if "base" in raw.columns else whole(raw)).select(*columns).mapInPandas(run, OBJECTS)


def csv_rows(raw: DataFrame) -> DataFrame:
    """Rows of CSV files whose headers differ from file to file, each as a map."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lines():
            for batch in batches:
                for owner, path, content in zip(batch["owner_id"], batch["path"], batch["content"]):
                    for i, row in enumerate(csv.DictReader(io.StringIO(content))):
                        cells = {k: v for k, v in row.items() if k is not None and isinstance(v, str)}
                        if any(v != "" for v in cells.values()):
                            yield owner, path, i, cells

        for rows in in_slices(lines()):
            yield pd.DataFrame(rows, columns=["owner_id", "path", "position", "row"])

    return raw.select(*RAW).mapInPandas(
        run, "owner_id string, path string, position bigint, row map<string,string>")
