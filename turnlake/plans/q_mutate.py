"""Table changes and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.embed import embed_column
from ..operators.facets import totals
from ..operators.mutate import append, delete_by_prefix, merge_new, update_by_prefix
from ..session import checkpointed, scratch_path
from ..sources.files import read_json_entries
from ..sources.records import build_records, next_seq
from ..schema import RECORD_SCHEMA
from ..sources.sinks import CSV_HEADER, csv_line, write_csv, write_json
from ..sources.tables import doc_records, read_records, table, write_records
from .catalog import register
from .common import big, joined, r6
from .oracle_ctes import DOC_RECORDS, with_

NOW = 1735689600  # fixed clock of the registered change queries (2025-01-01 UTC)

_UPDATES_SQL = (
    "u AS (SELECT row_number() OVER (ORDER BY doc_id) AS useq, left(concat('d', lpad(CAST(doc_id AS VARCHAR), 8, '0')), 8) AS prefix "
    "FROM labels WHERE toxic = 1)"
)


@register(
    "update_by_prefix",
    with_(
        DOC_RECORDS, _UPDATES_SQL,
        "hit AS (SELECT u.useq, min(r.seq) AS seq FROM u JOIN doc_records r ON starts_with(r.id, u.prefix) GROUP BY u.useq)",
        "win AS (SELECT seq, max(useq) AS useq FROM hit GROUP BY seq)",
    )
    + "SELECT r.seq, r.id, CASE WHEN w.seq IS NULL THEN r.text ELSE 'redacted' END AS text, "
    "CASE WHEN w.seq IS NULL THEN array_to_string(r.tags, ',') ELSE 'toxic,redacted' END AS tags, "
    f"CASE WHEN w.seq IS NULL THEN r.timestamp ELSE {NOW} END AS timestamp FROM doc_records r LEFT JOIN win w USING (seq)",
)
def q_update_by_prefix(spark, sf_dir):
    """M2: for every toxic document, replace the *first* record whose id starts with the
    document id's first 8 characters (text, tags, clock)."""
    lab = table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    ups = lab.select(
        F.col("doc_id").alias("useq"),
        F.substring(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), 1, 8).alias("prefix"),
        F.lit("redacted").alias("text"), F.array(F.lit("toxic"), F.lit("redacted")).alias("tags"),
    )
    out, _ = update_by_prefix(doc_records(spark, sf_dir), ups, NOW)
    return out.select(big("seq").alias("seq"), "id", "text", joined("tags").alias("tags"), big("timestamp").alias("timestamp"))


@register(
    "delete_by_prefix",
    with_(DOC_RECORDS, "p AS (SELECT DISTINCT left(concat('d', lpad(CAST(doc_id AS VARCHAR), 8, '0')), 8) AS prefix FROM labels WHERE toxic = 1)")
    + "SELECT seq, id FROM doc_records r WHERE NOT EXISTS (SELECT 1 FROM p WHERE starts_with(r.id, p.prefix))",
)
def q_delete_by_prefix(spark, sf_dir):
    """M3: delete every record whose id starts with the first 8 characters of a toxic
    document's id."""
    lab = table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    pre = lab.select(F.substring(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), 1, 8).alias("prefix"))
    rem, _ = delete_by_prefix(doc_records(spark, sf_dir), pre)
    return rem.select(big("seq").alias("seq"), "id")


@register(
    "merge_tables",
    with_(
        DOC_RECORDS,
        "loc AS (SELECT seq, id FROM doc_records WHERE list_contains(tags, 'en'))",
        "rem AS (SELECT seq, id FROM doc_records WHERE list_contains(tags, 'hq'))",
        "nw AS (SELECT seq, id FROM rem WHERE id NOT IN (SELECT id FROM loc))",
    )
    + "SELECT seq, id FROM loc UNION ALL SELECT (SELECT max(seq) FROM loc) + row_number() OVER (ORDER BY seq) AS seq, id FROM nw",
)
def q_merge_tables(spark, sf_dir):
    """M4 + J2 + A3: a local table ('en' records) pulls a remote one ('hq' records): unknown
    ids are appended after the local maximum in remote order, known ids are never changed."""
    recs = doc_records(spark, sf_dir)
    merged, _ = merge_new(recs.where(F.array_contains("tags", "en")), recs.where(F.array_contains("tags", "hq")))
    return merged.select(big("seq").alias("seq"), "id")


_MIXED_PREFIXES = (
    "p(prefix) AS (SELECT 'd' UNION ALL SELECT 'zz' UNION ALL SELECT DISTINCT left(concat('d', lpad(CAST(doc_id AS VARCHAR), 8, '0')), 8) "
    "FROM labels WHERE toxic = 1)"
)


def _mixed_prefixes(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    own = lab.select(F.substring(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), 1, 8).alias("prefix"))
    return own.distinct().unionByName(spark.createDataFrame([("d",), ("zz",)], "prefix string"))


@register(
    "delete_counts",
    with_(DOC_RECORDS, _MIXED_PREFIXES)
    + "SELECT p.prefix, (SELECT count(*) FROM doc_records r WHERE starts_with(r.id, p.prefix)) AS deleted FROM p",
)
def q_delete_counts(spark, sf_dir):
    """M3 + A3: records deleted by each prefix, for one that all ids have and one that none has too."""
    _, counts = delete_by_prefix(doc_records(spark, sf_dir), _mixed_prefixes(spark, sf_dir))
    return counts.select("prefix", big("deleted").alias("deleted"))


@register(
    "update_twice",
    with_(
        DOC_RECORDS, _UPDATES_SQL,
        "u2 AS (SELECT useq * 2 AS useq, prefix, 'first' AS text, 'x' AS tags FROM u UNION ALL "
        "SELECT useq * 2 + 1, prefix, 'second', '' FROM u UNION ALL SELECT 0, 'zz', 'none', 'x')",
        "hit AS (SELECT u2.useq, min(r.seq) AS seq FROM u2 JOIN doc_records r ON starts_with(r.id, u2.prefix) GROUP BY u2.useq)",
        "win AS (SELECT seq, max(hit.useq) AS useq, max(CASE WHEN tags <> '' THEN hit.useq END) AS tseq FROM hit JOIN u2 USING (useq) GROUP BY seq)",
    )
    + "SELECT r.id, coalesce(a.text, r.text) AS text, coalesce(b.tags, array_to_string(r.tags, ',')) AS tags FROM doc_records r "
    "LEFT JOIN win w USING (seq) LEFT JOIN u2 a ON a.useq = w.useq LEFT JOIN u2 b ON b.useq = w.tseq "
    "UNION ALL SELECT 'unmatched', prefix, tags FROM u2 WHERE useq NOT IN (SELECT useq FROM hit)",
)
def q_update_twice(spark, sf_dir):
    """M2: two updates on each record, the second without tags; updates that match nothing come last."""
    prefix = F.substring(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")), 1, 8)
    numbered = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).withColumn("useq", F.col("doc_id") + 1)
    one = numbered.select((F.col("useq") * 2).alias("useq"), prefix.alias("prefix"), F.lit("first").alias("text"), F.array(F.lit("x")).alias("tags"))
    two = numbered.select((F.col("useq") * 2 + 1).alias("useq"), prefix.alias("prefix"), F.lit("second").alias("text"),
                          F.array().cast("array<string>").alias("tags"))
    none = spark.createDataFrame([(0, "zz", "none", ["x"])], "useq long, prefix string, text string, tags array<string>")
    out, unmatched = update_by_prefix(doc_records(spark, sf_dir), one.unionByName(two).unionByName(none), NOW)
    return out.select("id", "text", joined("tags").alias("tags")).unionByName(
        unmatched.select(F.lit("unmatched").alias("id"), F.col("prefix").alias("text"), joined("tags").alias("tags")))


@register(
    "merge_counts",
    with_(
        DOC_RECORDS,
        "loc AS (SELECT id FROM doc_records WHERE list_contains(tags, 'en'))",
        "rem AS (SELECT id FROM doc_records WHERE list_contains(tags, 'hq'))",
    )
    + "SELECT (SELECT count(DISTINCT id) FROM rem WHERE id NOT IN (SELECT id FROM loc)) AS added, "
    "(SELECT count(*) FROM loc) + (SELECT count(DISTINCT id) FROM rem WHERE id NOT IN (SELECT id FROM loc)) AS total",
)
def q_merge_counts(spark, sf_dir):
    """M4 + A3: how many records a merge adds, and how many there are then."""
    recs = doc_records(spark, sf_dir)
    _, counts = merge_new(recs.where(F.array_contains("tags", "en")), recs.where(F.array_contains("tags", "hq")))
    return counts.select(big("added").alias("added"), big("total").alias("total"))


_UUID_SQL = (
    "(SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-4' || substring(h, 14, 3) || '-8' || substring(h, 18, 3) "
    "|| '-' || substring(h, 21, 12) FROM (SELECT sha256(concat_ws(chr(31), '', '', CAST(x.seq AS VARCHAR), x.text)) AS h))"
)


@register(
    "append_records",
    with_(
        DOC_RECORDS,
        "x AS (SELECT (SELECT max(seq) FROM doc_records) + row_number() OVER (ORDER BY item_id) AS seq, text FROM benchmark)",
    )
    + "SELECT seq, id, timestamp, array_to_string(tags, ',') AS tags FROM doc_records UNION ALL "
    f"SELECT x.seq, {_UUID_SQL} AS id, {NOW} AS timestamp, 'benchmark' AS tags FROM x",
)
def q_append_records(spark, sf_dir):
    """M1 + S10 + E1: benchmark passages built into records (seq after the table's maximum,
    deterministic uuid ids, fixed clock, embedded vectors) and appended."""
    recs = doc_records(spark, sf_dir)
    entries = checkpointed(  # stable partitions for the numbering
        table(spark, sf_dir, "benchmark").orderBy("item_id").select("text", F.array(F.lit("benchmark")).alias("tags"))
    )
    new = build_records(entries, start_seq=next_seq(recs), now=NOW, vector=embed_column("text"))
    out = append(recs, new)
    return out.select(big("seq").alias("seq"), "id", big("timestamp").alias("timestamp"), joined("tags").alias("tags"))


_CSV_LINE = (
    "'\"' || id || '\",\"' || replace(text, '\"', '\"\"') || '\",\"' || "
    "replace(array_to_string(tags, ','), '\"', '\"\"') || '\",' || CAST(timestamp AS VARCHAR)"
)


@register("export_csv_lines", with_(DOC_RECORDS) + f"SELECT seq, {_CSV_LINE} AS line FROM doc_records")
def q_export_csv_lines(spark, sf_dir):
    """The reference's CSV export lines (quoted id/text/tags, doubled quotes, bare time)."""
    return doc_records(spark, sf_dir).select(big("seq").alias("seq"), csv_line().alias("line"))


@register("export_json_roundtrip", with_(DOC_RECORDS) + "SELECT id, text, array_to_string(tags, ',') AS tags FROM doc_records")
def q_export_json_roundtrip(spark, sf_dir):
    """S13 + S3 + S12: JSON export read back by the JSON source (ids kept)."""
    path = scratch_path(spark, "export")
    write_json(doc_records(spark, sf_dir), path)
    back = read_json_entries(spark, path, json_lines=True)
    return back.select("id", "text", joined("tags").alias("tags"))


@register(
    "export_csv_file",
    with_(DOC_RECORDS, f"f AS (SELECT '{CSV_HEADER}' AS entry UNION ALL SELECT {_CSV_LINE} FROM doc_records)")
    + "SELECT unnest(string_split(entry, chr(10))) AS line FROM f",
)
def q_export_csv_file(spark, sf_dir):
    """The CSV files with their header, read back line by line (a text may span several)."""
    path = scratch_path(spark, "csv-export")
    write_csv(doc_records(spark, sf_dir), path)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


@register(
    "export_full",
    with_(DOC_RECORDS)
    + "SELECT seq, ns, id, text, timestamp, array_to_string(tags, ',') AS tags, len(vector) AS dims, "
    "CAST(round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), 6) AS DOUBLE) AS items FROM doc_records",
)
def q_export_full(spark, sf_dir):
    """Full export (vectors, insertion order and namespace too), read back by the record schema."""
    path = scratch_path(spark, "full")
    write_json(doc_records(spark, sf_dir), path, with_vectors=True)
    back = spark.read.schema(RECORD_SCHEMA).json(path)
    items = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(big("seq").alias("seq"), "ns", "id", "text", big("timestamp").alias("timestamp"), joined("tags").alias("tags"),
                       big(F.size("vector")).alias("dims"), r6(items).alias("items"))


@register(
    "load_namespace",
    with_(DOC_RECORDS)
    + "SELECT seq, 'hq' AS ns, id, timestamp, len(vector) AS dims FROM doc_records WHERE list_contains(tags, 'hq')",
)
def q_load_namespace(spark, sf_dir):
    """A record table stored by namespace, of which one namespace is loaded."""
    path = scratch_path(spark, "table")
    ns = F.when(F.array_contains("tags", "hq"), "hq").otherwise("rest")
    write_records(doc_records(spark, sf_dir).withColumn("ns", ns), path)
    return read_records(spark, path, "hq").select(
        big("seq").alias("seq"), "ns", "id", big("timestamp").alias("timestamp"), big(F.size("vector")).alias("dims"))


@register("record_totals", with_(DOC_RECORDS) + "SELECT count(*) AS total FROM doc_records")
def q_record_totals(spark, sf_dir):
    """A3: number of records."""
    return totals(doc_records(spark, sf_dir)).select(big("total").alias("total"))
