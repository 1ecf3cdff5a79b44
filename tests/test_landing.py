"""Landed pages, files and snapshots as they arrive: short pages, gaps, odd documents, several batches."""

import json

from pyspark.sql import functions as F

from contrapunto.operators import resolve as R
from contrapunto.sources import scans as SC
from contrapunto.sources import sinks as SK
from contrapunto.streaming import streams as ST


def pages(spark, folder, sizes):
    rows = [(page, 100 * page + i) for page, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "page long, id long").write.partitionBy("page").json(str(folder))
    schema = spark.createDataFrame([], "id long").schema
    return sorted(r.id for r in SC.scan_pages(spark, str(folder), schema, 5).collect())


def test_paging_stops_at_the_short_page_and_at_a_gap(spark, tmp_path):
    full = [100 * p + i for p in range(3) for i in range(5)]
    assert pages(spark, tmp_path / "a", {0: 5, 1: 5, 2: 5, 3: 2, 4: 5}) == full + [300, 301]
    assert pages(spark, tmp_path / "b", {0: 5, 1: 5, 2: 5, 4: 5}) == full
    assert pages(spark, tmp_path / "c", {0: 5}) == full[:5]
    assert pages(spark, tmp_path / "d", {1: 5, 2: 1}) == []


def test_snapshot_documents_of_any_layout(spark, tmp_path):
    docs = {"a": json.dumps({"N1": {"status": "ok", "fields": {"titulo": "uno"}, "documents": [{"name": "d"}]}, "N2": None, "N3": {}}, indent=2),
            "b": json.dumps({"N4": {"status": "ok", "documents": None, "otro": 1}}), "c": "{}", "d": "<html>error</html>", "e": "[1, 2]", "f": json.dumps({"N5": {"documents": "mal"}, "N6": 7})}
    for name, text in docs.items():
        (tmp_path / name).write_text(text)
    got = {r.notice_id: r for r in SC.scan_snapshots(spark, str(tmp_path)).collect()}
    assert set(got) == {"N1", "N2", "N3", "N4", "N5", "N6"}
    assert got["N1"].fields == {"titulo": "uno"} and got["N1"].documents[0].name == "d" and got["N4"].status == "ok" and got["N4"].documents is None
    assert all(got[n].status is None and got[n].fields is None for n in ("N2", "N3", "N5", "N6"))
    assert sorted(r.file for r in SC.unreadable_snapshots(spark, str(tmp_path)).collect()) == ["d", "e"]


def test_raw_export_has_no_limit_of_columns(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        d = spark.createDataFrame([(i, {f"k{j}": f"v{i}{j}" for j in range(i, i + 30)}, {"k0": "x"}) for i in range(3)], "id long, m map<string,string>, n map<string,string>")
        out = SK.export_raw(d, ["id"], {"m": "a", "n": "a.b"})
        assert len(out.columns) == 1 + 32 + 1
        rows = {r["id"]: r.asDict() for r in out.collect()}
        assert rows[0]["a.k0"] == "v00" and rows[2]["a.k0"] is None and rows[2]["a.k31"] == "v231" and rows[1]["a.b.k0"] == "x"
        assert SK.export_raw(d, ["id"], {"m": "a"}, ["a.k2", "a.nada"]).orderBy("id").first().asDict() == {"id": 0, "a.k2": "v02", "a.nada": None}
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_a_bad_child_leaves_the_others_whole(spark):
    c = spark.createDataFrame([("C1", "P1"), ("C2", "P1")], "id_contrato string, process_id string")
    good = spark.createDataFrame([("C1", 5), ("C9", 6)], "id_contrato string, dias int")
    raw = spark.createDataFrame([("C1", '{"valor": 1.5, "x": {"y": [1]}}'), ("C2", '{"valor": "mucho"}'), ("C2", "{"), ("C2", None)], "id_contrato string, raw string")
    d = R.child_rows(c, {"a": lambda: good, "b": lambda: raw, "c": lambda: good.select("no_hay"), "d": lambda: spark.read.parquet("/no/hay")}, {"a": {"dias": "int"}, "b": {"valor": "decimal(9,2)"}})
    got = sorted((r.hijo, r.id_contrato or "", r.process_id or "", r.j or "", r.error or "") for r in d.withColumn("j", F.to_json("datos")).collect())
    assert got[:2] == [("a", "C1", "P1", '{"dias":5}', ""), ("a", "C9", "", '{"dias":6}', "")]
    assert got[2:6] == [("b", "C1", "P1", '{"valor":1.5,"x":{"y":[1]}}', ""), ("b", "C2", "P1", "", "ilegible"), ("b", "C2", "P1", "", "ilegible"), ("b", "C2", "P1", '{"valor":"mucho"}', "campos: valor")]
    assert [(x[0], x[4].split(":")[0]) for x in got[6:]] == [("c", "sin fuente"), ("d", "sin fuente")]


def test_every_pick_has_its_place(spark):
    rows = [(f"C{i:03}", "P1") for i in range(70)] + [("D1", "P2")]
    c = spark.createDataFrame(rows, "id_contrato string, process_id string")
    picks, members = R.siblings_of_all(c.where("id_contrato <> 'C003'"), c, 16)
    parts = {(r.process_id, r.part): r.miembros.split(" | ") for r in members.collect()}
    got = picks.collect()
    assert len(got) == 70 and members.count() == 6
    for r in got:
        assert parts[r.process_id, r.part][r.lugar] == r.elegido
        assert r.hermanos == sum(len(v) for (p, _), v in parts.items() if p == r.process_id) - 1


FIELDS = "id string, fase string, total long"


def arrivals(spark, folder, batches, store, patience=3):
    """Movements when the batches of (stamp, total, rows) arrive one after the other."""
    schema = spark.createDataFrame([], FIELDS + ", stamp string").schema
    for k, (stamp, total, rows) in enumerate(batches):
        spark.createDataFrame([(i, f, total, stamp) for i, f in rows], schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = ST.stream_movements(stream, store, f"{folder}/run", "id", {"cambio_fase": "fase"}, patience=patience)
    return sorted((r.foto, r.tipo, r.id) for r in out.collect())


def test_a_snapshot_in_two_batches_loses_nobody(spark, tmp_path):
    store = f"{tmp_path}/store"
    got = arrivals(spark, tmp_path, [("2024-01", 3, [("a", "x"), ("b", "x")]), ("2024-01", 3, [("c", "x")]), ("2024-02", 3, [("a", "y"), ("a", "y")]), ("2024-02", 3, [("b", "x"), ("d", "x")])], store)
    assert got == [("2024-02", "cambio_fase", "a"), ("2024-02", "desaparecido", "c"), ("2024-02", "nuevo", "d")]
    assert {r.stamp for r in SK.read_snapshots(spark, store).where("stamp <> 'none'").select("stamp").distinct().collect()} == {"2024-01", "2024-02"}


def test_an_unfinished_snapshot_is_set_aside(spark, tmp_path):
    batches = [("2024-01", 2, [("a", "x"), ("b", "x")]), ("2024-02", 2, [("a", "x")]), ("2024-03", 2, [("a", "y"), ("b", "x")]), ("2024-04", 9, [("a", "x")])]
    assert arrivals(spark, tmp_path / "waits", batches, f"{tmp_path}/s1") == []
    assert arrivals(spark, tmp_path / "goes", batches, f"{tmp_path}/s2", patience=1) == [("2024-03", "cambio_fase", "a")]
    aside = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/goes/run/aside").collect()
    assert [(r.stamp, r.estado) for r in aside] == [("2024-02", "incompleta")]
