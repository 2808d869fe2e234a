"""Leaderboard and leakage rules on hand-made cells and reports; sources on real files."""

import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldmark.operators import leaderboard as lb
from foldmark.operators import leakage as lk
from foldmark.plans import sources
from foldmark.session import dealt
from foldmark.sources import catalog, delimited, folds, manifest, results


def test_cell_rules(spark):
    cases = {"0.9": (1, 1), "0.9, None, 0.8": (2, 3), "None(es)": (0, 1), "": (0, 0), None: (0, 0), "1,2,3,4": (4, 4), "0.5 (note)": (1, 1), "unk": (0, 1)}
    cells = spark.createDataFrame([(k,) for k in cases], "cell string")
    parsed = cells.select(*[c.alias(n) for n, c in lb.parse_cell(F.col("cell")).items()])
    assert [tuple(r) for r in parsed.collect()] == list(cases.values())
    ok, total = F.col("ok"), F.col("total")
    labels = parsed.select(lb.pass_fraction(ok, total).alias("f"), lb.pass_rate(ok, total).alias("r")).collect()
    assert [r["f"] for r in labels] == ["1/3", "2/3", "0/3", "0/3", "0/3", "4/4", "1/3", "0/3"]
    assert labels[5]["r"] == 1.0


def test_runs_and_failures(spark):
    cells = spark.createDataFrame([(1, "0.9, Error x, nan, 0.8"), (2, "abc"), (3, "None"), (4, "0.5")], "id int, cell string")
    runs = lb.explode_runs(cells)
    assert sorted((r["id"], r["raw"]) for r in runs.collect()) == [(1, "0.8"), (1, "0.9"), (1, "Error x"), (4, "0.5")]
    rate = {r["id"]: r["valid_runs"] for r in lb.valid_run_rate(runs, ["id"]).collect()}
    assert rate == {1: 2, 4: 1}


def test_relative_performance_pads_to_three(spark):
    rows = [("up", "accuracy", 0.5, 1.0), ("up", "accuracy", 0.5, 0.5), ("down", "rmse", 2.0, 4.0), ("zero", "accuracy", 0.0, 4.0), ("none", "rmse", 2.0, None)]
    df = spark.createDataFrame(rows, "comp string, metric string, baseline double, score double")
    got = {r["comp"]: (r["rp"], r["rp_std"]) for r in lb.relative_performance(df, ["comp"]).collect()}
    assert math.isclose(got["up"][0], 1.0) and math.isclose(got["up"][1], math.sqrt(2 / 3))
    assert math.isclose(got["down"][0], 0.5 / 3) and got["zero"][0] == 0.0 and got["none"][0] == 0.0


def test_areas_match_their_integrals(spark):
    rng = random.Random(5)
    rs = [rng.random() * 1.6 - 0.1 for _ in range(300)] + [0.0, 1.0, 1e-9]
    df = spark.createDataFrame([(r,) for r in rs], "rp double")
    row = df.agg(*[F.avg(c).alias(n) for n, c in lb.area_terms(F.col("rp")).items()]).first()
    assert abs(row["AUP_std"] - row["AUP_std_grid"]) < 1e-3
    n = 200_000
    taus = [(i + 0.5) / n for i in range(n)]
    sorted_rs = sorted(rs)
    import bisect

    area = sum(bisect.bisect_right(sorted_rs, t) / len(rs) * -math.log(t) for t in taus) / n
    assert abs(row["AUP_ln"] - area) < 1e-4
    below = sum(r < 1 for r in rs) / len(rs)
    assert abs(row["AUP_invln"] - below) < 0.01


def test_profile_counts_shares(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.3,), (2.0,)], "rp double")
    rho = {round(r["tau"], 2): r["rho"] for r in lb.profile(df, [], points=5).collect()}
    assert rho == {0.0: 0.25, 0.25: 0.5, 0.5: 0.75, 0.75: 0.75, 1.0: 0.75}


def test_average_row_is_a_mean_of_means(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 3.0)], "model string, lang string, x double")
    rows = {r["lang"]: r["x"] for r in lb.with_average_row(df, ["model"]).collect()}
    assert rows["Avg."] == 2.0


def test_headers(spark):
    texts = ['# /a/b.py\n# ok\n"""boom\nTrace 1\nTrace 2\n"""\ncode', '# p\n#s\n"""e\n"""\nx', "# p\n# s", '# p\n# s\n"""e\nopen']
    df = lk.parse_headers(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = [(r["original_file_path"], r["entrypoint_status"], r["error_status"], r["traceback"]) for r in df.collect()]
    assert got == [
        ("/a/b.py", "ok", "boom", "Trace 1 Trace 2 "),
        ("p", "s", "e", None),
        ("p", "s", "BAD_HEADER_FORMAT", None),
        ("p", "s", "e", "open "),
    ]


def test_pages(spark):
    html = (
        '<table class="x sum"><tr><th>a</th></tr><tr><td>Pre-processing leakage</td><td>2</td></tr>'
        "<tr><td>Overlap leakage</td><td>x</td></tr></table>"
        '<button style="background-color: red">warn &lt;1&gt;</button>'
        '<button onclick="highlight_lines([3, 4])">highlight train/test sites</button>'
        '<button onclick="highlight_lines([9])">something else</button>'
        '<button onclick="mark_leak_lines([7])">show and go to first leak src</button>'
        '<button onclick="mark_leak_lines([8,10])">show and go to first leak src</button>'
    )
    row = lk.parse_reports(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert (row[0]["preprocessing_leakage"], row[0]["overlap_leakage"], row[0]["no_independence"]) == (2, 0, 0)
    assert row[0]["highlight_lines"] == [3, 4] and row[0]["mark_leak_lines"] == [7, 8, 10]
    assert row[0]["warnings"] == ["warn <1>"] and row[1]["warnings"] is None and row[1]["overlap_leakage"] is None


def test_enclosing_functions(spark):
    functions = spark.createDataFrame(
        [("f", "outer", ["a"], 1, 500), ("f", "inner", ["b", "c"], 100, 200), ("f", "again", ["z"], 100, 210), ("g", "x", [], 1, 5)],
        "file string, name string, args array<string>, start_line long, end_line long",
    )
    lines = spark.createDataFrame([("f", 150), ("f", 150), ("f", 300), ("f", 501), ("g", 9)], "file string, line int")
    got = {r["name"]: r["contains_lines"] for r in lk.enclosing_functions(lines, functions).collect()}
    assert got == {"outer": [150, 300], "again": [150]}


def test_separator_choice(spark, tmp_path):
    def choose(body):
        path = tmp_path / f"{abs(hash(body))}.csv"
        path.write_text(body)
        return delimited.choose_separator(spark, str(path))

    assert choose("a,b\n1,2\n") == ","
    assert choose('a,b\n"1,5",2\n') == ","
    assert choose("a;b\n1,5;2\n") == ";"
    assert choose("a;b\n1;2\n") == ","  # one column under a comma: a wrong separator that parses wins
    assert choose("a|b\n1,5|2;;\n3|4\n") == "|"


def test_catalog_and_tasks(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(
        '{"_note": {"metric": "x"}, "one": {"metric": "f1_score", "target_col": "y", "direction": "maximize", "cv_folds": 3},'
        ' "two": {"metric": "rmse", "target_col": ["a", "b"], "files": {"train": {"type": "data", "required": true, "extensions": [".csv"]}}}}'
    )
    rows = {r["comp_id"]: r for r in catalog.read_catalog(spark, str(tmp_path / "catalog.json")).collect()}
    assert set(rows) == {"one", "two"} and rows["two"]["target_col"] == ["a", "b"]
    assert rows["one"]["cv_folds"] == 3 and rows["two"]["cv_folds"] == 1 and rows["two"]["files"]["train"]["required"]
    tasks = tmp_path / "tasks"
    tasks.mkdir()
    (tasks / "English.csv").write_text('comp-id,description,data_card,domain,metric\none,"line 1\nline 2",card,health,f1\n')
    got = catalog.read_tasks(spark, str(tasks)).collect()
    assert [(r["comp-id"], r["lang"]) for r in got] == [("one", "English")]
    (tasks / "Klingon.csv").write_text("comp-id,description,data_card,domain,metric\none,a,b,c,d\n")
    with pytest.raises(ValueError):
        catalog.read_tasks(spark, str(tasks))


def test_manifest(spark, tmp_path):
    for name in ("train.csv", "extra.parquet", "sample_submission.csv", "README.md", "run.sh"):
        (tmp_path / name).write_text("x")
    files = manifest.list_files(spark, str(tmp_path))
    built = {r["key"]: r for r in manifest.build_manifest(files).collect()}
    assert set(built) == {"train", "extra", "README"} and built["train"]["required"] and built["README"]["file_type"] == "metadata"
    mapped = manifest.build_manifest(files, mapping={"train": {"filename": "absent.csv"}})
    assert [r["key"] for r in manifest.missing_files(mapped.fillna("none", ["path"]), files).collect()] == ["train"]


def test_fold_store(spark, tmp_path):
    df = spark.range(10).withColumn("w", F.col("id") * 2)
    folds.write_folds({"train": df, "excluded_train": df.select("w")}, str(tmp_path), "c")
    assert folds.read_fold(spark, str(tmp_path), "c", 0, "train").count() == 10
    with pytest.raises(ValueError):
        folds.read_excluded(spark, str(tmp_path), "c", 0)
    folds.write_folds({"excluded_val": df.select("w")}, str(tmp_path), "c")
    assert set(folds.read_excluded(spark, str(tmp_path), "c", 0)) == {"train", "val"}
    assert folds.read_excluded(spark, str(tmp_path / "nothing"), "c", 0) == {}


def test_folders_are_entries(spark, tmp_path):
    for name in ("train.csv", "images/a/b.png", "images/c.png", "Sample_data/x.csv", "train/y.csv", "baselines/z.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = manifest.list_files(spark, str(tmp_path))
    built = {r["key"]: (r["path"].rsplit("/", 1)[1], r["required"]) for r in manifest.build_manifest(files, root=str(tmp_path)).collect()}
    assert built == {"train": ("train.csv", True), "images": ("images", False)}


def test_versions_of_folds(spark, tmp_path):
    root = str(tmp_path)
    table = spark.range(60).withColumn("role", F.lit("train"))
    for k in (5, 3):
        folds.write_split(table.withColumn("fold", (F.col("id") % k).cast("int")), root, "c")
        folds.write_fold_set({f: {"train": table, "x_val": table} for f in range(k)}, root, "c")
    folds.write_split(table.withColumn("fold", F.lit(7)), root, "other")
    assert sorted(r["fold"] for r in folds.read_split(spark, root, "c").select("fold").distinct().collect()) == [0, 1, 2]
    folds.write_folds({"train": table.limit(4)}, root, "c", 1)
    assert len(folds.drop_old_versions(spark, root)) == 1  # single folds of the first run still stand where no later run has them
    assert [folds.read_fold(spark, root, "c", f, "train").count() for f in range(5)] == [60, 4, 60, 60, 60]
    assert folds.read_fold(spark, root, "c", 1).count() == 20 and folds.read_fold(spark, root, "other", 7).count() == 60
    with pytest.raises(FileNotFoundError):
        folds.read_fold(spark, root, "c", 9, "train")


def test_sheets_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',,,,,m1,,m2\n,name,base,,metric,English,French,English\n1,c1,0.5,d,rmse,"0.1,\n0.2",None,\n2,c2,x,d,r2,,,"0.3"\n')
    (tmp_path / "b.csv").write_text(",,,,,z\n,,,,,Kazakh,,Polish\n1,c9,1,d,r2,1,2,3\n")
    (tmp_path / "c.csv").write_text(",,,,,z\n,,,,,Kazakh\n")
    rows = results.read_sheets(spark, str(tmp_path)).collect()
    got = sorted((r["file"][-5], r["comp"], r["baseline"], r["metric"], r["model"], r["lang"], r["cell"] or "") for r in rows)
    assert got == [
        ("a", "c1", 0.5, "rmse", "m1", "English", "0.1,\n0.2"), ("a", "c1", 0.5, "rmse", "m1", "French", "None"), ("a", "c1", 0.5, "rmse", "m2", "English", ""),
        ("a", "c2", None, "r2", "m1", "English", ""), ("a", "c2", None, "r2", "m1", "French", ""), ("a", "c2", None, "r2", "m2", "English", "0.3"),
        ("b", "c9", 1.0, "r2", "z", "Kazakh", "1"), ("b", "c9", 1.0, "r2", "z", "Polish", "3"),
    ]


def test_sheet(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text(
        ",,,,,m1,,m2,\nno,comp_name,baseline_score,domain,metric,English,French,English,French\n"
        '1,c1,0.5,d,rmse,"0.1, 0.2",None,0.3,\n'
    )
    got = results.read_sheet(spark, str(tmp_path / "sheet.csv"))
    rows = sorted((r["model"], r["lang"], r["cell"]) for r in got.collect() if r["cell"])
    assert rows == [("m1", "English", "0.1, 0.2"), ("m1", "French", "None"), ("m2", "English", "0.3")]
    assert {r["baseline"] for r in got.collect()} == {0.5}


def test_report_folder(spark, tmp_path):
    (tmp_path / "m_1.py").write_text("# p\n# s\n")
    (tmp_path / "m_1.html").write_text("<html></html>")
    (tmp_path / "m_2.py").write_text("# p")
    (tmp_path / "m_2.ir.py").write_text("x")
    rows = results.read_reports(spark, str(tmp_path)).collect()
    assert sorted((r["python_file_path"].rsplit("/", 1)[1], r["html"] is not None) for r in rows) == [("m_1.py", True), ("m_2.py", False)]


def test_files_of_rows_have_their_names_and_lines(spark):
    rows = [("a=1/b:c.py", "one"), ("a=1/b:c.py", "two"), ("a=1/d%.html", "ä\n x"), ("e.txt", None), ("f.txt", ""), (None, "nameless")]
    root = sources._files(spark, spark.createDataFrame(rows, "name STRING, text STRING"))
    found = {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file() and p.suffix != ".crc"}
    assert {k: sorted(v.split("\n")) for k, v in found.items()} == {
        "a=1/b:c.py": ["", "one", "two"], "a=1/d%.html": ["", " x", "ä"], "e.txt": ["", ""], "f.txt": ["", ""]
    }


def test_many_files_are_not_named_one_by_one_by_the_driver(spark):
    rows = spark.range(3000).selectExpr("concat('c', id % 7, '/', id, '.png') AS name", "cast(id AS string) AS text")
    started = time.time()
    root = sources._files(spark, rows)
    assert time.time() - started < 20  # renamed by the driver they take minutes
    listed = manifest.list_images(spark, root).selectExpr("count(*) AS n", "count(distinct label) AS labels").first()
    assert (listed["n"], listed["labels"]) == (3000, 7)


def test_spans_move_in_few_blocks(spark):
    spans = [(a, a + n) for a in (-300, -64, -1, 0, 5, 63, 64, 1000) for n in (0, 1, 62, 63, 64, 300, 10**12)]
    rows = spark.createDataFrame(spans, "a LONG, b LONG")
    blocks = rows.select("a", "b", F.explode(lk.dyadic_blocks(F.col("a"), F.col("b"), low=6)).alias("k")).select("a", "b", "k.*").collect()
    held = {}
    for r in blocks:
        held.setdefault((r["a"], r["b"]), []).append((r["_number"] << r["_level"], (r["_number"] + 1 << r["_level"]) - 1))
    for a, b in spans:
        ranges = sorted(held[a, b])
        assert ranges[0][0] == a >> 6 << 6 and ranges[-1][1] == (b >> 6 << 6) + 63
        assert all(x[1] + 1 == y[0] for x, y in zip(ranges, ranges[1:]))
        assert b - a > 300 or len(ranges) <= 4  # down to single lines it takes up to 14


def test_functions_of_lines_against_brute_force(spark):
    random.seed(3)
    lines = [(f, random.randint(-200, 900)) for f in ("a", "b", None) for _ in range(60)] * 2 + [("a", None)]
    functions = [("a", "f", None, 7), ("b", "f", None, None)]
    for i in range(300):
        s = random.randint(-400, 1200)
        functions.append((random.choice(["a", "b", None]), f"f{i}", s, random.choice([s, s + 1, s + 63, s + 500, 10**13, s - 5, None])))
    best = {}
    for f, n, s, e in functions:
        if f and s is not None:
            best[f, s] = max(best.get((f, s), (-math.inf, "")), (-math.inf if e is None else e, n))
    want = {}
    for (f, s), (e, n) in best.items():
        found = sorted({x for g, x in lines if g == f and x is not None and s <= x <= e})
        if found:
            want[f, s] = (n, e, found)
    got = lk.enclosing_functions(spark.createDataFrame(lines, "file STRING, line LONG"), spark.createDataFrame(functions, "file STRING, name STRING, start_line LONG, end_line LONG"))
    assert {(r["file"], r["start_line"]): (r["name"], r["end_line"], r["contains_lines"]) for r in got.collect()} == want
    none = lk.enclosing_functions(spark.createDataFrame([], "file STRING, line LONG"), spark.createDataFrame(functions, "file STRING, name STRING, start_line LONG, end_line LONG"))
    assert none.count() == 0


def test_rows_of_one_sheet_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "SHEET_ROWS", 4)
    body = "".join(f"{i},c{i},1,d,r2,{i},{i + 1}\n" for i in range(200))
    (tmp_path / "a.csv").write_text(",,,,,m1,\nno,name,base,domain,metric,English,French\n" + body)
    rows = results.read_sheets(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 50  # the file is one
    assert sorted((int(r["comp"][1:]), r["lang"], int(r["cell"])) for r in rows.collect()) == sorted((i, n, i + k) for i in range(200) for k, n in enumerate(("English", "French")))


def test_rows_are_dealt_to_more_tasks_than_the_session_has(spark):
    df = spark.range(1000).selectExpr("id % 100 AS k")
    out = dealt(df, ["k"], 20)
    assert out.rdd.getNumPartitions() == 50 and out.groupBy("k").count().rdd.getNumPartitions() == 50
    assert dealt(df.limit(0), ["k"], 20).count() == 0
