"""File catalog with record framing, bucketed upserts, signatures by part."""

import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from revlens.operators import buckets, retrieval
from revlens.sources import catalog, ingest


def _write(tmp, name, text):
    p = os.path.join(tmp, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", newline="") as f:
        f.write(text)
    return p


def test_catalog_rows_and_detection(spark):
    tmp = tempfile.mkdtemp(prefix="revlens-cat-")
    paths = [_write(tmp, "a.csv", "Deal ID,Lead ID,Deal Amount\r\n1,2,3\r\n4,5,6\r\n"),
             _write(tmp, "my leads.csv", 'Lead ID,"Source, first"\n1,"two\nlines"\n2,"say ""x"""\n'),
             _write(tmp, "c.csv", "foo,Foo\n1,2\n"), _write(tmp, "d+1%20.csv", "foo,bar\n"),
             _write(tmp, "e.csv/part-0.csv", "Invoice ID,Amount\n1,2\n"), _write(tmp, "e.csv/part-1.csv", "Invoice ID,Amount\n3,4\n5,6\n"),
             _write(tmp, "f.csv/part-0.csv", "x,y\n1,2\n"), _write(tmp, "f.csv/part-1.csv", "x,z\n1,2\n")]
    _write(tmp, "empty.csv", "")
    paths = paths[:4] + [f"{tmp}/e.csv", f"{tmp}/f.csv", f"{tmp}/empty.csv"]
    got = {r["File_Name"]: r for r in catalog.detect_modules(catalog.file_catalog(spark, paths)).collect()}
    assert {n: (r["Module"], r["Found_By"], r["Lines"], r["Open_Lines"], r["Splittable"]) for n, r in got.items()} == {
        "a.csv": ("Deals", "columns", 2, 0, True), "my leads.csv": ("Leads", "name", 3, 2, False), "c.csv": ("Unknown", None, 1, 0, False),
        "d+1%20.csv": ("Unknown", None, 0, 0, True), "e.csv": ("Invoices", "columns", 3, 0, True), "f.csv": ("Unknown", None, 2, 0, False)}
    assert got["my leads.csv"]["Header_Columns"] == 2 and got["a.csv"]["Column_Score"] == 30


def test_detection_equals_the_one_file_rule(spark):
    tmp = tempfile.mkdtemp(prefix="revlens-cat-")
    headers = {"x1.csv": "Quote ID,Deal ID,Stage", "x2.csv": "Vendor ID,Amount,Purchase Order ID", "x3.csv": "Amount,Status", "sales_order-2.csv": "q",
               "invoice export.csv": "Deal ID,Lead ID,Amount", "so.csv": "z", "poll.csv": "Owner,Task ID", "x4.csv": "Account ID,Contact ID"}
    paths = [_write(tmp, n, h + "\n1\n") for n, h in headers.items()]
    got = {os.path.basename(catalog._plain(r["File_Path"])): r["Module"] for r in catalog.detect_modules(catalog.file_catalog(spark, paths)).collect()}
    for n, p in zip(headers, paths):
        columns = ingest.canonicalize_headers(ingest.read_csv_strings(spark, p))[0].columns
        assert got[n] == (ingest.detect_module(columns, n) or "Unknown"), n


def test_loaded_files_are_split_or_read_whole(spark):
    tmp = tempfile.mkdtemp(prefix="revlens-cat-")
    big = _write(tmp, "deals big.csv", "Deal ID,Lead ID,Amount\n" + "".join(f"{i},{i % 7},\"{i}\"\n" for i in range(60_000)))
    broken = _write(tmp, "leads.csv", 'Lead ID,Lead Source\n1,"a\nb"\n2,c\n')
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(100_000))
    try:
        used, _, unknown = ingest.load_modules(spark, [big, broken])
        assert used["Deals"].rdd.getNumPartitions() > 3 and unknown == []
        assert used["Deals"].agg(F.sum("Amount"), F.count("Deal_ID")).first()[:] == (sum(range(60_000)), 60_000)
        assert {(r["Lead_ID"], r["Lead_Source"]) for r in used["Leads"].collect()} == {("1", "a\nb"), ("2", "c")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def _files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{folder}/data") for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_only_its_buckets(spark):
    path = tempfile.mkdtemp(prefix="revlens-bk-") + "/c"
    old = spark.range(2000).select(F.col("id"), F.array(F.col("id").cast("float")).alias("embedding"), F.lit(1).cast("bigint").alias("version")) \
        .union(spark.createDataFrame([(None, [0.5], 1)], "id long, embedding array<float>, version long"))
    buckets.create(old, path, buckets=64)
    before = _files(path)
    new = spark.createDataFrame([(3, [9.0], 2), (4, [9.0], 0), (5, None, 7), (5000, [1.0], None), (None, [2.5], 2), (3, [8.0], 1)],
                                "id long, embedding array<float>, version long")
    want = sorted(retrieval.corpus_upsert(old, new).select("id", "embedding", "version").collect(), key=str)
    touched = buckets.upsert(new, path)
    after = _files(path)
    assert sorted(buckets.read(spark, path).collect(), key=str) == want and len(touched) <= 4
    assert before.items() <= after.items() and {p.split("__bucket=")[1].split("/")[0] for p in after.keys() - before.keys()} == {str(b) for b in touched}
    assert buckets.upsert(new.where("id = 5"), path) == [] == buckets.upsert(new.limit(0), path)
    assert sorted(buckets.read(spark, path).collect(), key=str) == want
    assert buckets.read(spark, path, commit=0).count() == 2001 and buckets.read(spark, path, commit=0).where("id = 5000").count() == 0


def test_upsert_into_an_empty_corpus(spark):
    path = tempfile.mkdtemp(prefix="revlens-bk-") + "/c"
    rows = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 1)], "id long, embedding array<float>, version long")
    buckets.create(rows.limit(0), path)
    assert buckets.read(spark, path).count() == 0
    buckets.upsert(rows, path)
    assert {r["id"] for r in buckets.read(spark, path).collect()} == {1, 2}


def test_changed_rows_are_found_by_part(spark):
    old = spark.range(5000).selectExpr("id", "id * 2 as v").union(spark.createDataFrame([(None, 1)], "id long, v long"))
    new = old.where("id is null or id != 17").withColumn("v", F.expr("case when id = 4000 then null else v end")).union(spark.createDataFrame([(9999, 1)], "id long, v long"))
    a, b = ingest.signature_parts(old, "id", 3), ingest.signature_parts(new, "id", 3)
    got = {r["Part"] for r in ingest.changed_parts(a, b).collect()}
    assert got == {hashlib.md5(str(i).encode()).hexdigest()[:3] for i in (17, 4000, 9999)}
    assert ingest.changed_parts(a, a).count() == 0
    root = ingest.table_signature({"T": old}).first()["Signature"]
    assert str(sum(int(r["Signature"]) for r in a.collect())) == root

