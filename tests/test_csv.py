"""CSV files in splits, records that do not fit, ids that are texts, and versions of a model."""

import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

import shipcause.plans.model as model_module
from checks import queries
from shipcause.fixed import TABLE_FILES
from shipcause.functions.values import normalize_missing
from shipcause.operators import quality
from shipcause.operators.fact import build_fact
from shipcause.operators.insights import insights_by
from shipcause.plans.model import open_model, refresh
from shipcause.sources import records, versions
from shipcause.sources.records import cell_count
from shipcause.sources.store import write_csv
from shipcause.sources.tables import RejectedRows, load_csv, load_csvs, load_csv_folder, load_csv_tables, profiles, read_csv
from tests.fixtures import tables
from tests.test_sources import FILES

SMALL_SPLITS = {
    "spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1",
}


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_SPLITS}
    for k, v in SMALL_SPLITS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(path, rows, quoting=csv.QUOTE_MINIMAL, newline="\n"):
    out = io.StringIO()
    csv.writer(out, quoting=quoting, lineterminator=newline).writerows(rows)
    path.write_text(out.getvalue(), newline="")


def cells(rng):
    """Cells with line breaks, delimiters and quotes, some longer than a split."""
    kind = rng.random()
    if kind < 0.6:
        return "".join(rng.choice("abc é") for _ in range(rng.randint(1, 6))) + "."
    return "".join(rng.choice('ab,\n"') for _ in range(rng.randint(1, 25) if kind < 0.98 else 4000)) + "."


@pytest.mark.parametrize(("seed", "newline"), [(1, "\n"), (2, "\r\n")])
def test_random_files_in_small_splits(spark, tmp_path, small_splits, seed, newline):
    rng = random.Random(seed)
    rows = [[cells(rng), f'{i}" x', cells(rng)] for i in range(250)]  # the middle cell is not quoted
    (tmp_path / "in").mkdir()
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set(',\n"') else c
    for part in range(2):
        lines = [",".join([quoted(a), b, quoted(c)]) for a, b, c in rows[part * 125 : part * 125 + 125]]
        (tmp_path / "in" / f"part-{part}.csv").write_text(newline.join(["a,b,c", *lines, ""]), newline="")
    got = read_csv(spark, f"{tmp_path}/in").orderBy("load_seq").collect()
    assert [list(r[:3]) for r in got] == rows
    assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/in").rdd.getNumPartitions() > 20
    assert [r.load_seq for r in got] == [*range(1, 126), *range(127, 252)]  # one number per header


def test_a_stray_quote_does_not_make_one_task(spark, tmp_path, small_splits):
    lines = ["id,size", *[f'{i},{i}" wide' if i == 3 else f"{i},plain" for i in range(2000)]]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    found = load_csv(spark, str(tmp_path / "t.csv"))
    assert found.rows.count() == 2000 and found.rejects.count() == 0
    assert found.rows.where("id = '3'").first().size == '3" wide'


def test_more_splits_than_are_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "BROADCAST_SPLITS", 0)
    rows = [[str(i), f"two\nlines, {i}"] for i in range(400)]
    written(tmp_path / "t.csv", [["id", "text"], *rows])
    got = read_csv(spark, str(tmp_path / "t.csv")).orderBy("load_seq").collect()
    assert [list(r[:2]) for r in got] == rows


def test_cells_are_counted_as_they_are_cut(spark):
    texts = ["", "a", "a,b", '"a,b",c', '"a""b,",c', 'a"b,c"d', '"a"b,c', ',"",', '"x\ny,z",', '"open, and,']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cell_count(F.col("t"))).collect()] == [1, 1, 2, 2, 2, 2, 2, 3, 2, 1]
    assert df.select(cell_count(F.lit("a;b,c"), ";")).first()[0] == 2


BROKEN = 'a,b\n1,2\n1,2,3\n4\n\n   \n5,"x\ny"\n6,""\n7,"open\n8,9\n10,11\n'


def test_records_that_do_not_fit(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text(BROKEN)
    found = load_csv(spark, path, short_rows="reject")
    rejects = [(r.position, r.reason, r.cells, r.record) for r in found.rejects.orderBy("position").collect()]
    assert rejects == [(2, "surplus cells", 3, "1,2,3"), (3, "missing cells", 1, "4"), (8, "open quote", None, '7,"open\n8,9\n10,11')]
    assert all(r.file.endswith("/t.csv") for r in found.rejects.collect())
    rows = lambda df: [tuple(r) for r in df.orderBy("load_seq").collect()]
    assert rows(found.rows) == [("1", "2", 1), ("5", "x\ny", 6), ("6", None, 7)]
    assert rows(read_csv(spark, path, on_reject="skip")) == [("1", "2", 1), ("4", None, 3), ("5", "x\ny", 6), ("6", None, 7)]
    with pytest.raises(RejectedRows, match="record 2: surplus cells.*record 8: open quote"):
        read_csv(spark, path)
    for wrong in ({"on_reject": "x"}, {"short_rows": "x"}):
        with pytest.raises(ValueError, match="unknown"):
            read_csv(spark, path, **{"on_reject": "skip"} | wrong)


def test_a_quote_left_open_over_many_splits(spark, tmp_path, small_splits):
    """No task gathers the rest of the file: its pieces are told one by one."""
    (tmp_path / "t.csv").write_text('a,b\n1,2\n3,"never closed\n' + "4,5\n" * 2000)
    found = load_csv(spark, str(tmp_path / "t.csv"))
    assert [tuple(r[:2]) for r in found.rows.collect()] == [("1", "2")]
    pieces = found.rejects.collect()
    assert len(pieces) > 3 and {(r.position, r.reason) for r in pieces} == {(2, "open quote")}


def test_parts_with_another_header(spark, tmp_path):
    for name, header in [("0.csv", "a,b"), ("1.csv", "b,a"), ("2.csv", "a,b")]:
        (tmp_path / name).write_text(f"{header}\n1,2\n")
    found = load_csv(spark, str(tmp_path))
    assert [(r.file.rsplit("/", 1)[-1], r.reason) for r in found.rejects.collect()] == [("1.csv", "header")]
    assert found.rows.count() == 3


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b\n")
    assert load_csv(spark, str(tmp_path / "none.csv")).rows.columns == ["load_seq"]
    only = load_csv(spark, str(tmp_path / "head.csv"))
    assert only.rows.columns == ["a", "b", "load_seq"] and only.rows.count() == 0 and only.rejects.count() == 0


@pytest.fixture()
def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_text(content)
    return tmp_path


def test_one_text_id_makes_text_of_the_column_everywhere(spark, folder):
    (folder / "orders.csv").write_text(FILES["orders.csv"].replace("\n2,1,Bob", "\nORD-2,1,Bob"))
    (folder / "feedback.csv").write_text(FILES["feedback.csv"].replace("\n2,4,", "\nORD-2,4,"))
    tables = load_csv_tables(spark, str(folder))
    types = {t: dict(df.dtypes) for t, df in tables.items()}
    assert {types[t]["order_id"] for t in types if "order_id" in types[t]} == {"string"}
    assert types["raw_orders"]["client_id"] == types["raw_fleet_logs"]["driver_id"] == "bigint"
    for preset in ("model", "cli"):
        orders = tables["raw_orders"].withColumn("amount", F.lit("1.5"))
        fact = build_fact(tables | {"raw_orders": orders}, preset)
        ratings = {r.order_id: r.feedback_rating_avg for r in fact.collect()}
        assert ratings == {"1": None, "ORD-2": 4.0}
    causes = fact.select("city", "order_id", "delay_hours", "is_late", F.array(F.lit("traffic")).alias("causes"))
    assert sorted(insights_by(causes, ["city"]).first().sample_orders) == ["1", "ORD-2"]


def test_ids_as_they_are_written(spark, folder):
    assert dict(load_csv_tables(spark, str(folder))["raw_orders"].dtypes)["order_id"] == "bigint"
    for odd in ("007", "+7", "7.0", "1" * 25):
        (folder / "clients.csv").write_text(f"client_id,client_name,created_at\n{odd},A,2024-01-01\n")
        rows = load_csv_folder(spark, str(folder), files={"dim_clients": TABLE_FILES["dim_clients"]}).tables["dim_clients"]
        assert rows.first().client_id == odd


def test_schema_log(spark, folder):
    log = quality.schema_log(load_csv_tables(spark, str(folder))).collect()
    by = {(r.table_name, r.column_name): (r.declared, r.found, r.rejected) for r in log}
    assert by["raw_orders", "amount"] == ("double", "string", 1)  # the text "bad"
    assert by["raw_orders", "order_date"] == ("timestamp_ntz", "timestamp_ntz", 0)
    (folder / "drivers.csv").write_text("driver_id\n1\n")
    log = quality.schema_log(load_csv_folder(spark, str(folder), files={"dim_drivers": "drivers.csv"}).tables).collect()
    assert {r.column_name: (r.found, r.rejected) for r in log} == {"driver_id": ("bigint", 0), "created_at": (None, None)}


# ---- versions -----------------------------------------------------------------------


def test_a_build_that_fails_leaves_the_old_model(spark, folder, tmp_path_factory, monkeypatch):
    out = str(tmp_path_factory.mktemp("model"))
    with pytest.raises(FileNotFoundError, match="nothing has been published"):
        open_model(spark, out)
    refresh(spark, str(folder), out)
    old = open_model(spark, out)
    (folder / "orders.csv").write_text(FILES["orders.csv"] + "3,1,Cy,Pune,MH,Delivered,COD,1,,2025-08-03,2025-08-04,,2025-08-03\n")
    save = model_module.save_model

    def half(tables, version):
        save(tables, version)
        raise RuntimeError("lost")

    monkeypatch.setattr(model_module, "save_model", half)
    with pytest.raises(RuntimeError, match="lost"):
        refresh(spark, str(folder), out)
    assert open_model(spark, out).fact.count() == 2
    assert len(list((tmp_path_factory.getbasetemp() / out.rsplit("/", 1)[-1] / "versions").iterdir())) == 1
    monkeypatch.setattr(model_module, "save_model", save)
    refresh(spark, str(folder), out)
    assert open_model(spark, out).fact.count() == 3 and old.fact.count() == 2  # readers of the one before go on


def test_versions(spark, tmp_path):
    folder = str(tmp_path)
    assert versions.published(spark, folder) == []
    names = []
    for n in range(4):
        version = versions.new_version(folder)
        spark.range(n).write.parquet(version)
        if n:
            assert versions.current(spark, folder) == names[-1]  # not before it is published
        versions.publish(spark, folder, version)
        names.append(version)
        assert versions.current(spark, folder) == version
    versions.prune(spark, folder, keep=2)
    assert [f"{folder}/versions/{v}" for _, v in versions.published(spark, folder)] == names[2:]
    assert sorted(p.name for p in (tmp_path / "versions").iterdir()) == sorted(n.rsplit("/", 1)[-1] for n in names[2:])
    versions.prune(spark, folder, keep=0)
    assert versions.current(spark, folder) == names[3]


def test_files_without_quotes_are_cut_without_python(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    for part in range(3):
        lines = [f"{part}-{i},{i},{'x' * (i % 40)}" for i in range(200)]
        (tmp_path / "in" / f"part-{part}.csv").write_text("\n".join(["a,b,c", *lines, ""]))
    cut = records.csv_records(spark, [f"{tmp_path}/in"]).cut
    assert "MapInArrow" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert cut.select("block").distinct().count() > 3
    rows = read_csv(spark, f"{tmp_path}/in").orderBy("load_seq").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(f"{p}-{i}", str(i), "x" * (i % 40) or None) for p in range(3) for i in range(200)]
    assert [r.load_seq for r in rows] == [p * 201 + i + 1 for p in range(3) for i in range(200)]


def test_types_of_all_tables_in_one_job(spark, tmp_path):
    late = [("", "x")] * 1500 + [("2025-08-01", "y")]  # the only date is far down
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(late)], "order_id int, order_date string, city string").coalesce(1)
    found = profiles({"raw_orders": df, "raw_feedback": df.selectExpr("city as order_id", "'none' as created_at")})
    assert found["raw_orders"].dates == {"order_date": True} and found["raw_orders"].texts == {"order_id": 0}
    assert found["raw_feedback"].dates == {"created_at": False} and found["raw_feedback"].texts == {"order_id": 1501}


def test_schema_log_does_not_check_values_of_the_declared_type(spark):
    df = spark.createDataFrame([(1, "x"), (None, "NA")], "driver_id long, driver_name string")
    log = quality.schema_log({"dim_drivers": df})
    assert "TRY" not in log._jdf.queryExecution().optimizedPlan().toString().upper()
    assert {r.column_name: r.rejected for r in log.collect()} == {"driver_id": 0, "created_at": None}


def test_plain_records_are_cut_as_the_parser_cuts_them(spark, tmp_path):
    """Without quotes generated code cuts cells: white space, marks, control characters, empty cells and short records."""
    rng = random.Random(3)
    for sep in (",", "|", "\t"):
        lines = ["".join(rng.choice(sep * 2 + "ab é#\0\r\\'") for _ in range(rng.randint(0, 9))) + "." for _ in range(300)]
        folder = tmp_path / f"in{ord(sep)}"
        folder.mkdir()
        (folder / "0.csv").write_text("\n".join([sep.join("abcd"), *lines]), newline="", encoding="utf-8-sig")
        (folder / "1.csv").write_text("\n".join([sep.join("abcd"), sep.join("1234")]), newline="")
        found = load_csv(spark, str(folder), delimiter=sep)
        split = {i: line.count(sep) + 1 for i, line in enumerate(lines, 1)}
        text = spark.createDataFrame([(i, line) for i, line in enumerate(lines, 1) if split[i] <= 4], "n long, t string")
        cells = text.select("n", F.from_csv("t", "a string, b string, c string, d string", {"sep": sep, "escape": '"'}).alias("r")).collect()
        assert {(r.load_seq, *r[:4]) for r in found.rows.collect()} == {(r.n, *r.r) for r in cells} | {(302, *"1234")}
        assert {(r.position, r.reason, r.cells) for r in found.rejects.collect()} == {(i, "surplus cells", n) for i, n in split.items() if n > 4}


def test_each_table_is_cut_into_files_of_its_own(spark, tmp_path):
    """One folder for all would deal a table's files to a few tasks, beside those of the others."""
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("id,x\n" + "".join(f"{i},NA\n" for i in range(50)))
    loads = load_csvs(spark, {name: str(tmp_path / f"{name}.csv") for name in ("a", "b")})
    files = {name: set(load.rows.inputFiles()) for name, load in loads.items()}
    assert files["a"] and files["b"] and not files["a"] & files["b"]


def test_missing_values_are_one_lookup_a_cell(spark):
    """A comparison per token and column does not fit in generated code: interpreted, it took most of a load."""
    columns = [f"c.{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(["NA", None, "x", "", " NA"] * 3)[:12]], ", ".join(f"`{c}` string" for c in columns))
    got = normalize_missing(df)
    assert got.columns == columns and got.first()[:5] == (None, None, "x", None, " NA")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") <= len(columns)


def test_written_csv_is_compressed_in_bounded_parts(spark, tmp_path, small_splits):
    """A part is read whole by one task; the order of rows goes over parts, and quotes within them."""
    df = spark.range(1000).selectExpr("id", "if(id % 7 = 0, concat('a \"', id, '\",\\n'), 'plain plain plain') as text")
    path = write_csv(df.orderBy("id"), str(tmp_path / "t.csv"), "gzip", rows_per_file=90)
    parts = sorted((tmp_path / "t.csv").glob("part-*"))
    assert len(parts) >= 12 and {p.suffix for p in parts} == {".gz"}
    assert sum(p.stat().st_size for p in parts) < sum(len(gzip.decompress(p.read_bytes())) for p in parts) / 2
    assert max(gzip.decompress(p.read_bytes()).count(b"plain plain") for p in parts) <= 90
    got = read_csv(spark, path).orderBy("load_seq").collect()
    assert [(int(r.id), r.text) for r in got] == [tuple(r) for r in df.orderBy("id").collect()]
    assert write_csv(df, str(tmp_path / "plain.csv")) and {p.suffix for p in (tmp_path / "plain.csv").glob("part-*")} == {".csv"}


@pytest.mark.parametrize("name", ["csv_dated_tables", "load_row_counts", "dq_schema"])
def test_tables_written_as_csv_leave_little_on_disk(spark, tmp_path, monkeypatch, name):
    """Plain text of all tables is many times their size; compressed, all rows come back in their order."""
    day = "2025-08-01 09:00:00"
    small = tables(
        spark,
        raw_orders=[{"order_id": i, "client_id": 1, "amount": 1.5, "order_date": day} for i in range(1, 301)],
        raw_feedback=[{"order_id": i, "rating": "4", "feedback_text": 'two\n"lines"', "created_at": day} for i in range(1, 201)],
    )
    monkeypatch.setattr(queries, "load_tables", lambda *_: small)
    monkeypatch.setattr(queries, "new_folder", lambda *_: str(tmp_path / "csv"))
    found = [r.asDict() for r in queries.QUERIES[name](spark, "").collect()]
    parts = {t: list((tmp_path / "csv" / file).glob("part-*")) for t, file in TABLE_FILES.items()}
    assert {p.suffix for of in parts.values() for p in of} == {".gz"}
    assert sum(p.stat().st_size for p in parts["raw_orders"]) * 4 < sum(len(gzip.decompress(p.read_bytes())) for p in parts["raw_orders"])
    if name == "load_row_counts":
        assert {r["table_name"]: r["row_count"] for r in found if r["row_count"]} == {"raw_orders": 300, "raw_feedback": 200}
    elif name == "dq_schema":
        assert {(r["table_name"], r["column_name"]): r["rejected"] for r in found if r["rejected"]} == {("raw_orders", "amount"): 15}
    else:
        dates = sorted((r["table_name"], r["key"], r["column_name"], r["value"]) for r in found if r["value"])
        want = [("raw_feedback", i, "created_at", day) for i in range(1, 201)] + [("raw_orders", i, "order_date", day) for i in range(1, 301)]
        assert dates == want
