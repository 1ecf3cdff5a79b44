"""Batched edits of the watch list, in their order.

Two edits can only meet through a link or a process id that both name, or that one item joins.  Edits and the
items they touch are therefore dealt to components of shared keys (links, ids), and each component is
a small state machine: its items first, then its edits by ``ord``, streamed past in one sorted pass that
keeps the items and nothing else.  Untouched items never move.  Edits of one item are sequential by nature; a
link with very many edits is one stream, not a collected group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.functions.identifiers import contains_link_of, infer_process_id
from contrapunto.session import settled


def shared_components(members: DataFrame) -> DataFrame:
    """``id`` and ``comp`` (least id reachable over shared keys) of the rows (id, key)."""
    state = members.groupBy("id").agg(F.min("id").alias("comp"))
    while True:
        low = members.join(state, "id").groupBy("key").agg(F.min("comp").alias("low"))
        # a label that is an id itself is followed at once, so paths halve
        new = members.join(low, "key").groupBy("id").agg(F.min("low").alias("low"))
        jump = new.join(new.select(F.col("id").alias("low"), F.col("low").alias("far")), "low", "left")
        after = settled(jump.select("id", F.least("low", "far").alias("comp")))
        if not after.join(state.withColumnRenamed("comp", "was"), "id").where("comp <> was").limit(1).count():
            return after
        state = after


class Watch:
    """The items of one component; ``step`` applies an edit and returns (state, item, note before)."""

    def __init__(self):
        self.items: list[dict] = []

    def find(self, test) -> dict | None:
        return next((i for i in self.items if test(i)), None)

    def put(self, url, pid, note, sheets, years) -> dict:
        self.items.append({"url": url, "process_id": pid, "note": note, "hojas": list(sheets), "vigencias": list(years)})
        return self.items[-1]

    @staticmethod
    def listed(item: dict, sheet: str | None, year: str | None) -> bool:
        new = sheet is not None and sheet not in item["hojas"]
        if new:
            item["hojas"].append(sheet)
        if year is not None and year not in item["vigencias"]:
            item["vigencias"].append(year)
            new = True
        return new

    def step(self, e) -> tuple[str, dict | None, str | None]:
        if e.op != "remove" and not e.valid:
            return "dominio_invalido", None, None
        if e.op == "add":
            item = self.find(lambda i: i["url"] == e.target or (e.pid is not None and i["process_id"] == e.pid))
            if item is None:
                return "aplicado", self.put(e.target, e.pid, e.note, [e.sheet] if e.sheet else [], [e.year] if e.year else []), None
            return "ampliado" if self.listed(item, e.sheet, e.year) else "duplicado", item, item["note"]
        item = self.find(lambda i: i["url"] == e.url)
        if item is None:
            return "no_encontrado", None, None
        before = item["note"]
        if e.op == "remove":
            self.items = [i for i in self.items if i is not item]
            return "aplicado", item, before
        if self.find(lambda i: i is not item and (i["url"] == e.target or (e.moved and e.pid is not None and i["process_id"] == e.pid))):
            return "conflicto", item, before
        was = (item["url"], item["process_id"], item["note"])
        item["url"] = e.target
        if e.moved and e.pid is not None:
            item["process_id"] = e.pid
        if e.note is not None:
            item["note"] = e.note
        added = self.listed(item, e.sheet, e.year)
        return "aplicado" if added or was != (item["url"], item["process_id"], item["note"]) else "sin_cambio", item, before


_OUT = ("es_item boolean, ord long, op string, url string, process_id string, antes string, despues string, estado string, "
        "hojas array<string>, vigencias array<string>")


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    comp, watch = None, Watch()
    names = [f.split()[0] for f in _OUT.split(", ")]
    none = lambda v: None if v is None or v != v else v

    def left():
        return [(True, None, None, i["url"], i["process_id"], None, i["note"], None, i["hojas"], i["vigencias"]) for i in watch.items]

    for b in batches:
        out = []
        b = b.astype(object).where(b.notna(), None)
        for e in b.itertuples(index=False):
            if e.comp != comp:
                out += left()
                comp, watch = e.comp, Watch()
            if e.ord is None:
                watch.put(e.url, e.pid, e.note, e.hojas, e.vigencias)
                continue
            state, item, before = watch.step(e)
            out.append((False, e.ord, e.op, e.url, none(e.pid) or (item or {}).get("process_id"), before, e.note, state, None, None))
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(left(), columns=names)


def apply_edits(watch: DataFrame, edits: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """Applies add/edit/remove in the order of ``ord`` and returns (watch, log).

    ``watch``: url, process_id, note and ``sheet`` or its lists ``hojas``, ``vigencias``.  ``edits``: ord, op, url,
    new_url, note, sheet.  An edit sees what the ones before it left.  Adding a known link or id appends its sheet
    and year (``ampliado``), or changes nothing (``duplicado``).  A link outside the domain, a missing target, a
    link or id that another item has, and an edit that changes nothing are logged and leave the list as it is.
    """
    year = lambda c: F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit(""))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    w = watch if "hojas" in watch.columns else watch.withColumn("hojas", F.array_compact(F.array("sheet")))
    w = w if "vigencias" in w.columns else w.withColumn("vigencias", F.array_distinct(F.array_compact(F.transform("hojas", year))))
    w = w.select("url", F.col("process_id").alias("pid"), "note", "hojas", "vigencias").withColumn("id", F.concat(F.lit("i"), "url"))
    e = edits.withColumn("url", F.coalesce(F.trim("url"), F.lit(""))).withColumn("target", F.coalesce(clean("new_url"), "url"))
    e = e.withColumns({"pid": infer_process_id("target"), "note": clean("note"), "sheet": clean("sheet"), "moved": F.col("target") != F.col("url"), "valid": contains_link_of("target", domain)})
    e = e.withColumns({"year": year("sheet"), "ord": F.col("ord").cast("long"), "id": F.concat(F.lit("e"), F.col("ord").cast("string"))})
    key = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(kind), c))
    named = e.select("id", F.explode(F.array_distinct(F.array_compact(F.array(key("u", "url"), key("u", "target"), key("p", "pid"))))).alias("key"))
    owned = w.select("id", F.explode(F.array_compact(F.array(key("u", "url"), key("p", "pid")))).alias("key"))
    touched = owned.join(named.select("key").distinct(), "key", "left_semi").select("id").distinct()
    members = settled(named.unionByName(owned.join(touched, "id", "left_semi")))
    comps = shared_components(members)
    columns = ["comp", "ord", "op", "url", "target", "pid", "note", "sheet", "year", "moved", "valid", "hojas", "vigencias"]
    rows = e.join(comps, "id").unionByName(w.join(comps, "id"), allowMissingColumns=True).select(*columns)
    done = settled(rows.repartition("comp").sortWithinPartitions("comp", F.col("ord").asc_nulls_first(), "url").mapInPandas(_replayed, _OUT))
    log = done.where("not es_item").select("ord", "op", "url", "process_id", "antes", "despues", "estado")
    kept = done.where("es_item").select("url", "process_id", F.col("despues").alias("note"), "hojas", "vigencias")
    rest = w.join(touched, "id", "left_anti").select("url", F.col("pid").alias("process_id"), "note", "hojas", "vigencias")
    return kept.unionByName(rest).withColumn("sheet", F.get("hojas", 0)).select("url", "process_id", "note", "sheet", "hojas", "vigencias"), log
