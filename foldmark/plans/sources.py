"""Source and sink queries: tables are written to the shared folder in the wanted form and read back."""

from __future__ import annotations

import uuid

import pyarrow
import pyarrow.fs
from pyspark.sql import functions as F

from foldmark.functions import vectors
from foldmark.operators import split
from foldmark.operators.leakage import pair_reports
from foldmark.plans import query
from foldmark.plans.splits import LIMIT, draw
from foldmark.session import delete_path, shared_dir, shuffle_partitions
from foldmark.sources import catalog, delimited, folds, loaders, manifest, results
from foldmark.tables import table


@query("SRC1_read_csv_smart", "SELECT event_id, user_id, event_type, value, 'a,b' AS note FROM events")
def src1(spark, sf):
    path = shared_dir(spark, "csv")
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.lit("a,b").alias("note"))
    delimited.write_csv(df, path, sep=";")
    return delimited.read_csv_smart(
        spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, note STRING"
    )


@query(
    "SRC1_quoted_newlines",
    """SELECT CASE WHEN event_id % 11 <> 0 THEN event_id END AS event_id, value, event_type || chr(10) || '"a";b' AS note,
       event_id % 11 = 0 AS bad FROM events""",
)
def src1_lines(spark, sf):
    """Line breaks, separators and quotes inside a cell, and keys that are no numbers."""
    path = shared_dir(spark, "csv")
    key = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.col("event_id").cast("string"))
    note = F.concat("event_type", F.lit('\n"a";b'))
    delimited.write_csv(table(spark, sf, "events").select(key.alias("event_id"), "value", note.alias("note")), path, sep=";")
    out = delimited.read_csv_smart(spark, path, "event_id BIGINT, value DOUBLE, note STRING", sep=";", corrupt="_bad", multiLine=True)
    return out.withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


@query(
    "SRC1_mixed_dialects",
    """SELECT event_id % 3 AS kind, event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE value END AS value, 'Заказ ' || event_type || ', "' || event_id || '"' AS note,
       event_id % 50 = 7 AS bad FROM events""",
)
def src1_mixed(spark, sf):
    """One folder with commas and UTF-8, semicolons in a Cyrillic code page, and tabs, each with quotes and commas in a cell and some bad numbers."""
    root = shared_dir(spark, "csv")
    key = F.col("event_id")
    value = F.when(key % 50 == 7, "none").otherwise(F.col("value").cast("string"))
    note = F.concat(F.lit("Заказ "), "event_type", F.lit(', "'), key.cast("string"), F.lit('"'))
    df = table(spark, sf, "events").select("event_id", value.alias("value"), note.alias("note"))
    for kind, (sep, encoding) in enumerate(((",", "utf-8"), (";", "windows-1251"), ("\t", "utf-8"))):
        delimited.write_csv(df.filter(key % 3 == kind), f"{root}/kind{kind}", sep=sep, encoding=encoding)
    out = delimited.read_csv_folder(spark, root, "event_id BIGINT, value DOUBLE, note STRING", fallback="windows-1251", corrupt="_bad")
    kind = F.regexp_extract("file", "/kind([0-9])/", 1).cast("bigint")
    return out.select(kind.alias("kind"), "event_id", "value", "note", F.col("_bad").isNotNull().alias("bad"))


@query("SRC2_localized_csv", "SELECT c_custkey, 'Клиент ' || c_custkey AS name, c_acctbal FROM customer")
def src2(spark, sf):
    path = shared_dir(spark, "csv")
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("Клиент "), F.col("c_custkey").cast("string")).alias("name"),
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("c_acctbal"),
    )
    delimited.write_csv(df, path, sep=";", encoding="windows-1251")
    return delimited.read_csv_smart(
        spark, path, "c_custkey BIGINT, name STRING, c_acctbal DOUBLE", sep=";", encoding="windows-1251", decimal=","
    )


@query(
    "SRC2_bad_cells",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS c_acctbal, c_custkey % 10 = 3 AS bad,
       CASE WHEN c_custkey % 10 = 3 THEN c_custkey || ';12.5.x' END AS record FROM customer""",
)
def src2_bad(spark, sf):
    """Cells under a decimal comma that are no numbers are NULL, and their records are told."""
    path = shared_dir(spark, "csv")
    key = F.col("c_custkey")
    number = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    delimited.write_csv(table(spark, sf, "customer").select("c_custkey", F.when(key % 10 == 3, "12.5.x").otherwise(number).alias("c_acctbal")), path, sep=";")
    out = delimited.read_csv_smart(spark, path, "c_custkey BIGINT, c_acctbal DOUBLE", sep=";", decimal=",", corrupt="_bad")
    return out.select("c_custkey", "c_acctbal", F.col("_bad").isNotNull().alias("bad"), F.col("_bad").alias("record"))


@query(
    "SRC3_catalog",
    """SELECT 'comp-' || o_orderkey AS comp_id, CASE o_orderstatus WHEN 'F' THEN 'f1_score' ELSE 'roc_auc_score' END AS metric,
       CASE WHEN o_orderkey % 3 = 0 THEN 'a|b' ELSE 'target' END AS targets, o_orderkey % 4 + 1 AS cv_folds,
       CASE WHEN o_orderkey % 2 = 0 THEN 'time_series' ELSE 'csv' END AS split_strategy FROM orders""",
)
def src3(spark, sf):
    key = F.col("o_orderkey").cast("string")
    entry = F.concat(
        F.lit('{"_note": {"text": "skip"}, "comp-'), key, F.lit('": {"metric": "'),
        F.when(F.col("o_orderstatus") == "F", "f1_score").otherwise("roc_auc_score"),
        F.lit('", "target_col": '),
        F.when(F.col("o_orderkey") % 3 == 0, '["a", "b"]').otherwise('"target"'),
        F.lit(', "cv_folds": '), (F.col("o_orderkey") % 4 + 1).cast("string"),
        F.when(F.col("o_orderkey") % 2 == 0, ', "split_strategy": "time_series"').otherwise(""),
        F.lit("}}"),
    )
    path = shared_dir(spark, "catalog")
    table(spark, sf, "orders").select(entry.alias("value")).write.text(path)
    out = catalog.read_catalog(spark, path, lines=True)
    return out.select("comp_id", "metric", F.array_join("target_col", "|").alias("targets"), "cv_folds", "split_strategy")


@query("SRC4_language_tasks", "SELECT lang, 'doc-' || doc_id AS comp, source AS domain, n_chars FROM documents")
def src4(spark, sf):
    path = shared_dir(spark, "tasks")
    df = table(spark, sf, "documents").select(
        "lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("comp"), F.col("source").alias("domain"), "n_chars"
    )
    df.write.partitionBy("lang").options(header=True).csv(path)
    return catalog.read_tasks(
        spark, path, "comp STRING, domain STRING, n_chars BIGINT", pattern=r"/lang=([^/]+)/", languages=["de", "en", "es", "fr"]
    )


@query(
    "SRC5_file_manifest",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'data' WHEN 1 THEN 'metadata' WHEN 2 THEN 'data' WHEN 3 THEN 'data' WHEN 4 THEN 'other' ELSE 'data' END AS file_type,
       o_orderkey % 6 = 5 AS is_submission, CASE o_orderkey % 6 WHEN 0 THEN 'train' || o_orderkey WHEN 1 THEN 'README' || o_orderkey WHEN 2 THEN 'notes' || o_orderkey
       WHEN 3 THEN 'img.v' || o_orderkey WHEN 4 THEN 'run' || o_orderkey ELSE 'Sample_Submission' || o_orderkey END AS key FROM orders""",
)
def src5(spark, sf):
    k = F.col("o_orderkey") % 6
    stem = F.element_at(F.array(*[F.lit(x) for x in ("train", "README", "notes", "img.v", "run", "Sample_Submission")]), (k + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".md", ".txt", ".PNG", ".sh", ".csv")]), (k + 1).cast("int"))
    paths = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("data/"), "o_orderstatus", F.lit("/"), stem, F.col("o_orderkey").cast("string"), end).alias("path")
    )
    return manifest.describe_files(paths).select("o_orderkey", "key", "file_type", "is_submission")


def _stored(spark, sf):
    root = shared_dir(spark, "folds")
    drawn = split.kfold(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 3)
    folds.write_split(split.expand_folds(drawn, 3), root, "orders-comp")
    return root


_FOLD = f"SELECT o_orderkey, o_custkey, o_totalprice, {draw('o_orderkey')} % 3 AS val FROM orders"


@query(
    "SRC6_fold_sink",
    f"""SELECT fold, CASE WHEN val = fold THEN 'val' ELSE 'train' END AS role, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys
       FROM ({_FOLD}), (SELECT unnest(range(3)) AS fold) GROUP BY 1, 2""",
)
def src6(spark, sf):
    stored = folds.read_split(spark, _stored(spark, sf), "orders-comp")
    return stored.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SRC7_fold_source", f"SELECT o_orderkey, o_custkey, o_totalprice FROM ({_FOLD}) WHERE val = 1")
def src7(spark, sf):
    return folds.read_fold(spark, _stored(spark, sf), "orders-comp", 1, role="val")


@query(
    "SRC7_fold_parts",
    f"""WITH t AS (SELECT *, {draw('o_orderkey')} < {LIMIT} AS v FROM orders)
       SELECT 'train' AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM t WHERE NOT v UNION ALL SELECT 'x_val', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM t WHERE v
       UNION ALL SELECT 'w_train', count(*), CAST(sum(o_custkey) AS BIGINT) FROM t WHERE NOT v UNION ALL SELECT 'w_val', count(*), CAST(sum(o_custkey) AS BIGINT) FROM t WHERE v""",
)
def src7_parts(spark, sf):
    root = shared_dir(spark, "folds")
    drawn = split.holdout(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])
    folds.write_folds(split.project_role(drawn, "o_totalprice", weight="o_custkey"), root, "orders-comp")
    aside = folds.read_excluded(spark, root, "orders-comp", 0)
    parts = {
        "train": (folds.read_fold(spark, root, "orders-comp", 0, "train"), "o_orderkey"),
        "x_val": (folds.read_fold(spark, root, "orders-comp", 0, "x_val"), "o_orderkey"),
        "w_train": (aside["train"], "o_custkey"),
        "w_val": (aside["val"], "o_custkey"),
    }
    out = None
    for name, (df, key) in parts.items():
        line = df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")).withColumn("part", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "SRC8_tensor_source",
    """SELECT vec_id, label, 64 AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 255)), 9) AS total FROM embeddings""",
)
def src8(spark, sf):
    path = shared_dir(spark, "tensor")
    pixels = F.transform("embedding", lambda x: F.array(x))
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(pixels, r * 8 + 1, F.lit(8)))
    table(spark, sf, "embeddings").select("vec_id", "label", image.alias("image")).write.parquet(path)
    flat = F.flatten(vectors.flatten_trailing(F.col("image")))
    df = spark.read.parquet(path).select("vec_id", "label", vectors.rescale(flat, 255).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", "label", F.size("v").alias("n"), F.round(total, 9).alias("total"))


@query(
    "SRC9_image_listing",
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '.jpg' AS path FROM pages)
       SELECT page_id, list_last(string_split(path, '/')) AS image, string_split(path, '/')[-2] AS label, 'root/data/' || list_last(string_split(path, '/')) AS full_path FROM p""",
)
def src9(spark, sf):
    paths = table(spark, sf, "pages").select(
        "page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".jpg")).alias("path")
    )
    out = manifest.image_table(paths)
    return out.select("page_id", "image", "label", manifest.image_path(F.lit("root"), "data", F.col("image")).alias("full_path"))


@query(
    "SRC10_result_files",
    """SELECT 's' || event_id AS submission_id, event_type AS comp, 'm' || (user_id % 4) AS model, CASE WHEN event_id % 8 <> 0 THEN value END AS score,
       event_id % 8 <> 0 AS success, CASE WHEN event_id % 8 <> 0 THEN 0 ELSE 1 END AS n_errors FROM events""",
)
def src10(spark, sf):
    path = shared_dir(spark, "results")
    ok = F.col("event_id") % 8 != 0
    table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("submission_id"),
        F.col("event_type").alias("comp"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.when(ok, F.col("value")).alias("score"),
        F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit("failed"))).alias("errors"),
        ok.alias("success"),
    ).write.json(path)
    return results.read_results(spark, path).select(
        "submission_id", "comp", "model", "score", "success", F.size("errors").alias("n_errors")
    )


@query(
    "SRC11_leaderboard_sheet",
    """WITH c AS (SELECT user_id AS comp, event_type AS model, event_id % 2 AS l, printf('%.2f', max(value)) AS cell FROM events GROUP BY 1, 2, 3),
       g AS (SELECT comp, unnest(['click', 'view', 'click', 'view']) AS model, unnest([0, 0, 1, 1]) AS l FROM (SELECT DISTINCT user_id AS comp FROM events))
       SELECT g.comp, g.model, CASE g.l WHEN 0 THEN 'EN' ELSE 'FR' END AS lang, cell FROM g LEFT JOIN c ON g.comp = c.comp AND g.model = c.model AND g.l = c.l""",
)
def src11(spark, sf):
    keyed = table(spark, sf, "events").select(
        F.col("user_id").alias("comp"),
        F.concat_ws("_", "event_type", (F.col("event_id") % 2).cast("string")).alias("cell_key"),
        "value",
    )
    wide = keyed.groupBy("comp").pivot("cell_key", ["click_0", "click_1", "view_0", "view_1"]).agg(
        F.max("value")
    )
    filled = wide.select(
        "comp", *[F.when(F.col(c).isNotNull(), F.format_string("%.2f", c)).alias(c) for c in wide.columns if c != "comp"]
    )
    return results.unpivot_sheet(filled, results.fill_right(["click", None, "view", ""]), ["EN", "FR", "EN", "FR"], ["comp"])


@query(
    "SRC12_report_pairs",
    """SELECT p.page_id, 'r/' || p.page_id || '.py' AS python_file_path, CASE WHEN p.page_id % 2 = 0 THEN length(html) END AS html_length FROM pages p""",
)
def src12(spark, sf):
    pages = table(spark, sf, "pages")
    stem = F.concat(F.lit("r/"), F.col("page_id").cast("string"))
    py = pages.select("page_id", F.concat(stem, F.lit(".py")).alias("path"))
    html = pages.filter("page_id % 2 = 0").select(F.concat(stem, F.lit(".html")).alias("path"), F.col("html").alias("text"))
    out = pair_reports(py, html)
    return out.select("page_id", "python_file_path", F.length("html").alias("html_length"))


@query("SRC13_submission_sink", "SELECT event_id AS id, round(value * 2, 4) AS prediction FROM events")
def src13(spark, sf):
    path = shared_dir(spark, "submission")
    pred = table(spark, sf, "events").select("event_id", F.round(F.col("value") * 2, 4).alias("p"), "ts")
    delimited.write_submission(pred, path, "event_id", "p", ["id", "prediction"])
    return delimited.read_csv_smart(spark, path, "id BIGINT, prediction DOUBLE", sep=",")


@query("SRC14_analysis_sink", "SELECT doc_id, lang, '[\"' || source || '\"]' AS tags FROM documents")
def src14(spark, sf):
    path = shared_dir(spark, "analysis")
    df = table(spark, sf, "documents").select("doc_id", "lang", F.array("source").alias("tags"))
    delimited.write_analysis(df, path, "csv")
    return delimited.read_csv_smart(spark, path, "doc_id BIGINT, lang STRING, tags STRING", sep=",")


@query(
    "SRC7_load_by_strategy",
    f"""WITH t AS (SELECT o_orderkey, {draw('o_orderkey')} < {LIMIT} AS v FROM orders)
       SELECT o_orderkey, 'x_val' AS part, '/data/' || o_orderkey || '.jpg' AS content FROM t WHERE v UNION ALL
       SELECT o_orderkey, 'y_val', (o_orderkey % 19) || '|7' FROM t WHERE v UNION ALL
       SELECT o_orderkey, 'train', '/data/' || o_orderkey || '.jpg ' || (o_orderkey % 19) || '|7' FROM t WHERE NOT v""",
)
def src7_strategy(spark, sf):
    root = shared_dir(spark, "folds")
    key = F.col("o_orderkey").cast("string")
    photos = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(key, F.lit(".jpg")).alias("ImageID"),
        F.concat((F.col("o_orderkey") % 19).cast("string"), F.lit("  7")).alias("Labels"),
    )
    entry = {"target_col": "Labels", "image_col": "ImageID", "split_strategy": "photo_classification", "load_strategy": "photo_classification"}
    loaders.prepare_folds(photos, entry, root, "photos", ["o_orderkey"])
    parts = loaders.load_fold(spark, entry, root, "photos", 0, ids=["o_orderkey"])
    image = F.replace("ImageID", F.lit(root), F.lit(""))
    labels = F.array_join(F.transform("Labels", lambda x: x.cast("string")), "|")
    contents = {"x_val": image, "y_val": labels, "train": F.concat_ws(" ", image, labels)}
    out = None
    for name, content in contents.items():
        line = parts[name].select("o_orderkey", F.lit(name).alias("part"), content.alias("content"))
        out = line if out is None else out.unionByName(line)
    return out


def _writer(root, staged):
    """For the tasks: files of rows sorted by name. A file gets its name when it is whole, so what a task leaves behind is never half a file."""

    def write(batches):
        store, top = pyarrow.fs.FileSystem.from_uri(root)
        own = f"{pyarrow.fs.FileSystem.from_uri(staged)[1]}/{uuid.uuid4().hex}"
        store.create_dir(own)
        folders, name, out, n = set(), None, None, 0

        def finish():
            out.close()
            target = f"{top}/{name.decode()}"
            folder = target.rpartition("/")[0]
            if folder not in folders:
                store.create_dir(folder)
                folders.add(folder)
            store.move(f"{own}/{n}", target)

        for batch in batches:
            for key, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != name:
                    if out is not None:
                        finish()
                    name, n = key, n + 1
                    out = store.open_output_stream(f"{own}/{n}")
                out.write((text or b"") + b"\n")
        if out is not None:
            finish()
        yield pyarrow.RecordBatch.from_pydict({"files": pyarrow.array([n], pyarrow.int64())})

    return write


def _files(spark, df):
    """A folder with one file per name of the rows (name, text), a line per row; the tasks write them, rows without a name have none.

    The shared folder has to lie in a store that pyarrow opens: a mounted disk, S3, GCS, Azure, or HDFS with its client library.
    """
    root, staged = shared_dir(spark, "files"), shared_dir(spark, "staged")
    rows = df.filter(F.col("name").isNotNull()).select(F.col("name").cast("binary").alias("name"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartition(shuffle_partitions(spark), "name").sortWithinPartitions("name")
    rows.mapInArrow(_writer(root, staged), "files LONG").agg(F.sum("files")).collect()  # one number
    delete_path(spark, staged)
    return root


@query(
    "SRC5_folder_manifest",
    r"""WITH n AS (SELECT n_nationkey AS k, n_name FROM nation),
       f AS (SELECT k, CASE k % 5 WHEN 0 THEN 'table' || k || '.csv' WHEN 1 THEN 'README' || k || '.md' WHEN 2 THEN 'Sample_Submission' || k || '.csv'
         WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'baseline_' ELSE 'images' END || k ELSE 'run' || k || '.sh' END AS item FROM n)
       SELECT 'train' AS key, 'data' AS file_type, true AS required, NULL AS name, true AS missing
       UNION ALL SELECT CASE WHEN k % 5 < 3 THEN regexp_replace(item, '\.[a-z]+$', '') ELSE item END, CASE WHEN k % 5 = 1 THEN 'metadata' ELSE 'data' END, false, item, false
       FROM f WHERE k % 5 IN (0, 1) OR (k % 5 = 3 AND k % 2 = 1)""",
)
def src5_folder(spark, sf):
    """Files and folders of a dataset as they are found: a required file is missing, submissions, scripts and a baseline folder are left out."""
    k = F.col("n_nationkey")
    text = k.cast("string")
    name = (
        F.when(k % 5 == 0, F.concat(F.lit("table"), text, F.lit(".csv"))).when(k % 5 == 1, F.concat(F.lit("README"), text, F.lit(".md")))
        .when(k % 5 == 2, F.concat(F.lit("Sample_Submission"), text, F.lit(".csv")))
        .when(k % 5 == 3, F.concat(F.when(k % 2 == 0, "baseline_").otherwise("images"), text, F.lit("/deep/a.csv"))).otherwise(F.concat(F.lit("run"), text, F.lit(".sh")))
    )
    root = _files(spark, table(spark, sf, "nation").select(name.alias("name"), F.col("n_name").alias("text")))
    files = manifest.list_files(spark, root)
    built = manifest.build_manifest(files, root=root)
    missing = manifest.missing_files(built.fillna("none", ["path"]), files).select("key", F.lit(True).alias("missing"))
    return built.join(missing, "key", "left").select(
        "key", "file_type", "required", F.substring_index("path", "/", -1).alias("name"), F.coalesce("missing", F.lit(False)).alias("missing")
    )


@query(
    "SRC9_image_folder",
    """SELECT s_suppkey || '.' || CASE s_suppkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' ELSE 'jpeg' END AS image, 'nation' || s_nationkey AS label, length(s_name) + 1 AS length
       FROM supplier WHERE s_suppkey % 4 <> 0""",
)
def src9_folder(spark, sf):
    """Images below class folders, with notes among them."""
    key = F.col("s_suppkey")
    end = F.when(key % 4 == 0, ".txt").when(key % 3 == 0, ".png").when(key % 3 == 1, ".JPG").otherwise(".jpeg")
    name = F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("/"), key.cast("string"), end)
    root = _files(spark, table(spark, sf, "supplier").select(name.alias("name"), F.col("s_name").alias("text")))
    sizes = manifest.list_files(spark, root)
    return manifest.list_images(spark, root).join(sizes, "path").select("image", "label", F.col("length").cast("bigint").alias("length"))


@query(
    "SRC12_report_folder",
    """SELECT 'm' || (page_id % 3) || '_' || page_id || '.py' AS python_file, CASE WHEN page_id % 2 = 0 THEN 'm' || (page_id % 3) || '_' || page_id || '.html' END AS html_file,
       length('# ' || coalesce(url, '')) + 1 AS code_chars, CASE WHEN page_id % 2 = 0 THEN length(html) + 1 END AS html_chars FROM pages""",
)
def src12_folder(spark, sf):
    """A folder of programs, their reports as far as there are any, and intermediate files that are not programs."""
    pages = table(spark, sf, "pages")
    stem = F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string"), F.lit("_"), F.col("page_id").cast("string"))
    code = pages.select(F.concat(stem, F.lit(".py")).alias("name"), F.concat(F.lit("# "), F.coalesce("url", F.lit(""))).alias("text"))
    html = pages.filter("page_id % 2 = 0").select(F.concat(stem, F.lit(".html")).alias("name"), F.col("html").alias("text"))
    more = pages.filter("page_id % 5 = 0").select(F.concat(stem, F.lit(".ir.py")).alias("name"), F.lit("x").alias("text"))
    rows = results.read_reports(spark, _files(spark, code.unionByName(html).unionByName(more)))
    return rows.select(
        F.substring_index("python_file_path", "/", -1).alias("python_file"), F.substring_index("html_file_path", "/", -1).alias("html_file"),
        F.length("text").cast("bigint").alias("code_chars"), F.length("html").cast("bigint").alias("html_chars"),
    )


@query(
    "SRC6_rerun_with_fewer_folds",
    f"""WITH t AS (SELECT o_orderkey, {draw('o_orderkey')} AS h FROM orders), f AS (SELECT unnest(range(3)) AS fold)
       SELECT 'split' AS part, CAST(fold AS INTEGER) AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM t, f GROUP BY fold
       UNION ALL SELECT 'train', CAST(fold AS INTEGER), count(*), CAST(sum(o_orderkey) AS BIGINT) FROM t, (SELECT unnest(range(2)) AS fold) WHERE h % 2 <> fold GROUP BY fold""",
)
def src6_rerun(spark, sf):
    """Five folds and then three, and single folds written twice: readers find the last version whole, and nothing of the first."""
    root = shared_dir(spark, "folds")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    for k in (5, 3):
        folds.write_split(split.expand_folds(split.kfold(orders, ["o_orderkey"], k), k), root, "orders-comp")
    drawn = split.kfold(orders, ["o_orderkey"], 2)
    for part in (orders, drawn):
        folds.write_fold_set({f: {"train": part.filter(F.col("fold") != f) if "fold" in part.columns else part} for f in range(2)}, root, "orders-comp")
    folds.drop_old_versions(spark, root)
    out = folds.read_split(spark, root, "orders-comp").withColumn("part", F.lit("split"))
    out = out.select("part", "fold", "o_orderkey")
    for f in range(2):
        one = folds.read_fold(spark, root, "orders-comp", f, "train")
        out = out.unionByName(one.select(F.lit("train").alias("part"), F.lit(f).alias("fold"), "o_orderkey"))
    return out.groupBy("part", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
