"""Portal pages to fields, documents and notices.

HTML needs a real parser, so Python cuts each page into table rows and label pairs, in
Arrow batches; a task holds the rows of ``SLICE`` pages.  Every rule about labels, documents and
notices is a column expression over those rows and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrapunto import schemas as S
from contrapunto.functions.text import squeeze, strip_accents

# ---- Fixed values -----------------------------------------------------------

PLACEHOLDER = r"translator\.loadFile|loadFileAndTranslate"
NOISE = ["si", "no", "*", ""]
DOWNLOAD_CALL = (r"getAction\(\s*'(/Public/Tendering/[A-Za-z]+/DownloadFile)'\s*\+\s*'\?'\s*\+\s*'documentFileId='\s*\+\s*'(\d+)'"
                 r"(?:.*?'mkey=' ?\+ ?'([0-9a-f_]+)')?")
FILE_NAME = r"\.(pdf|docx?|xlsx?|zip|rar|jpe?g|png|txt)\b"
GRID_IDS = ["documentlist", "griddocument"]
NAME_CLASS = "VortalSpan"
NOTICE = "notificacion"
NOTICE_DATE = r"(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}\s*(?:AM|PM|a\.?m\.?|p\.?m\.?)?)"

# ---- Cutting (Python) -------------------------------------------------------

#: Pages whose rows and pairs a task holds at once; an Arrow batch may have 10,000.
SLICE = 200

CUT = T.StructType([
    T.StructField("rows", T.ArrayType(T.StructType([
        T.StructField("grid", T.BooleanType()), T.StructField("name", T.StringType()), T.StructField("call", T.StringType()),
        T.StructField("cells", T.ArrayType(T.StringType()))]))),
    T.StructField("pairs", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("shown", T.StringType()), T.StructField("typed", T.StringType())]))),
])


class _Box:
    """Text and first input value of an element that is still open."""

    def __init__(self):
        self.pieces, self.typed, self.labels = [], None, []

    def shown(self) -> str:
        return " ".join(p for p in map(str.strip, self.pieces) if p)


class _Cutter(HTMLParser):
    """Table rows with their cells, and every label with the box that follows it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.pairs = [], []
        self.in_rows, self.in_cells, self.in_tables = [], [], []
        self.label = self.name = self.muted = None
        self.free = None       # a pair outside a table that waits for the next element
        self.beside = None     # (tag, box) of that element

    def boxes(self) -> list[_Box]:
        beside = self.beside[1] if self.beside else None
        return [*self.in_cells, *(b for b in (self.label, self.name, beside) if b)]

    def handle_data(self, data):
        if not self.muted:
            for box in self.boxes():
                box.pieces.append(data)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        row = self.in_rows[-1] if self.in_rows else None
        if tag in ("script", "style"):
            self.muted = tag
        if self.free and tag not in ("br", "i", "em"):
            self.beside = (tag, _Box())
            self.free["box"], self.free = self.beside[1], None
        if tag == "table":
            self.in_tables.append(any(g in (a.get("id") or "").lower() for g in GRID_IDS))
        elif tag == "tr":
            self.in_rows.append({"grid": any(self.in_tables), "name": None, "call": None, "boxes": []})
            self.rows.append(self.in_rows[-1])
        elif tag == "td" and row:
            self.in_cells.append(_Box())
            row["boxes"].append(self.in_cells[-1])
        elif tag == "label":
            self.label = _Box()
        elif tag == "span" and NAME_CLASS in (a.get("class") or "").split():
            self.name = _Box()
        elif tag == "a" and row and not row["call"]:
            row["call"] = a.get("onclick")
        elif tag == "input" and a.get("value"):
            for box in self.boxes():
                box.typed = box.typed or a["value"]
            if self.beside and self.beside[0] == "input":
                self.beside = None

    def handle_endtag(self, tag):
        if tag == self.muted:
            self.muted = None
        if self.beside and tag == self.beside[0]:
            self.beside = None
        if tag == "label" and self.label:
            pair = {"label": self.label.shown(), "box": None}
            self.pairs.append(pair)
            self.label = None
            if self.in_cells:
                self.in_cells[-1].labels.append(pair)
            else:
                self.free = pair
        elif tag == "span" and self.name:
            if self.in_rows and self.in_rows[-1]["name"] is None:
                self.in_rows[-1]["name"] = self.name.shown()
            self.name = None
        elif tag == "td" and self.in_cells:
            self.in_cells.pop()
        elif tag == "tr" and self.in_rows:
            boxes = self.in_rows.pop()["boxes"]
            for box, after in zip(boxes, boxes[1:]):
                for pair in box.labels:
                    pair["box"] = after
        elif tag == "table" and self.in_tables:
            self.in_tables.pop()


def cut_page(html: str | None) -> tuple[list[dict], list[dict]]:
    """Rows and label pairs of one page, in page order; an empty page has none."""
    page = _Cutter()
    page.feed(html or "")
    page.close()
    rows = [{"grid": r["grid"], "name": r["name"], "call": r["call"], "cells": [b.shown() for b in r["boxes"]]} for r in page.rows]
    pairs = [{"label": p["label"], "shown": p["box"].shown() if p["box"] else None, "typed": p["box"].typed if p["box"] else None} for p in page.pairs]
    return rows, pairs


def cut_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key``, ``rows`` and ``pairs`` of every page."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), SLICE):
                part = b.iloc[at:at + SLICE]
                cut = [cut_page(h) for h in part[html]]
                yield pd.DataFrame({key: part[key], "rows": pd.Series([c[0] for c in cut], index=part.index, dtype=object), "pairs": pd.Series([c[1] for c in cut], index=part.index, dtype=object)})

    schema = T.StructType([pages.schema[key], *CUT.fields])
    return pages.select(key, html).mapInPandas(run, schema)


# ---- Rules (column expressions) ---------------------------------------------


def label_name(c: Column) -> Column:
    """A label without accents, outer space and closing colons."""
    return F.trim(F.regexp_replace(strip_accents(c), r"[\s:]+$", ""))


def cell_value(c: Column) -> Column:
    """Non-empty lines of a cell joined by bars; a script placeholder is no value."""
    lines = F.transform(F.split(F.translate(c, " ", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.when(c.rlike(PLACEHOLDER), "").otherwise(F.coalesce(F.array_join(F.filter(lines, lambda x: x != ""), " | "), F.lit("")))


def _firsts(entries: Column) -> Column:
    """The first entry of each name; ``entries`` are structs that sort by (name, preference)."""
    return F.get(F.transform(F.array(F.array_sort(entries)), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (F.get(s, i - 1)["name"] != x["name"]))), F.lit(0))


def labels_of(pairs: Column, label_limit: int | None = None) -> Column:
    """Map of label to its first value that is not empty (empty if all are)."""
    found = F.transform(pairs, lambda p, i: F.struct(
        label_name(p["label"]).alias("name"), cell_value(F.coalesce(p["typed"], p["shown"])).alias("value"), i.alias("pos")))
    fits = lambda e: ~F.lower(e["name"]).isin(NOISE) & (F.lit(True) if label_limit is None else F.length(e["name"]) <= label_limit)
    ranked = F.transform(F.filter(found, fits), lambda e: F.struct(
        e["name"].alias("name"), (e["value"] == "").alias("blank"), e["pos"].alias("pos"), e["value"].alias("value")))
    return F.map_from_entries(F.transform(_firsts(ranked), lambda e: F.struct(e["name"], e["value"])))


def fields_of(labels: Column, value_limit: int | None = None) -> Column:
    """The curated keys among the labels that have a value."""
    width = lambda v: v if value_limit is None else F.left(v, F.lit(value_limit))
    known = F.create_map(*[F.lit(x) for kv in S.PORTAL_LABELS.items() for x in kv])
    kept = F.map_filter(labels, lambda k, v: F.map_contains_key(known, k) & (v != ""))
    return F.transform_values(F.transform_keys(kept, lambda k, v: F.element_at(known, k)), lambda k, v: width(v))


def download_url(call: Column, base: str) -> Column:
    """Address of a download call; its path, id and key are read from one match."""
    part = lambda i: F.regexp_extract(call, "(?i)" + DOWNLOAD_CALL, i)
    key = F.when(part(3) != "", F.concat(F.lit("&mkey="), part(3))).otherwise("")
    return F.when(part(2) != "", F.concat(F.lit(base), part(1), F.lit("?documentFileId="), part(2), key)).otherwise("")


def documents_of(rows: Column, base: str) -> Column:
    """Named rows with a download call: those of the document grid, else those whose name is a file's."""
    grid = F.filter(rows, lambda r: r["grid"])
    source = F.when(F.size(grid) > 0, grid).otherwise(F.filter(rows, lambda r: r["name"].rlike("(?i)" + FILE_NAME)))
    named = F.filter(source, lambda r: (F.trim(r["name"]) != "") & r["call"].isNotNull())
    found = F.transform(named, lambda r, i: F.struct(squeeze(r["name"]).alias("name"), i.alias("pos"), download_url(r["call"], base).alias("url")))
    in_order = F.array_sort(F.transform(_firsts(found), lambda d: F.struct(d["pos"].alias("pos"), d["name"].alias("name"), d["url"].alias("url"))))
    return F.transform(in_order, lambda d: F.struct(d["name"].alias("name"), d["url"].alias("url")))


def notices_of(rows: Column) -> Column:
    """Notice rows as process, event and date; a date inside the event's cell is taken out of it."""
    ours = F.filter(rows, lambda r: F.lower(label_name(F.get(r["cells"], F.lit(0)))) == NOTICE)
    told = F.filter(F.transform(ours, lambda r: F.filter(F.slice(r["cells"], 2, F.size(r["cells"])), lambda c: c != "")), lambda c: F.size(c) > 0)
    part = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(""))
    merged = lambda c: (F.size(c) == 2) & part(c, 1).rlike("(?i)" + NOTICE_DATE)
    return F.transform(told, lambda c: F.struct(
        part(c, 0).alias("proceso"),
        F.when(merged(c), F.trim(F.get(F.split(part(c, 1), "(?i)" + NOTICE_DATE, 2), F.lit(0)))).otherwise(part(c, 1)).alias("evento"),
        F.when(merged(c), F.trim(F.regexp_extract(part(c, 1), "(?i)" + NOTICE_DATE, 1))).otherwise(part(c, 2)).alias("fecha")))


def parse_pages(pages: DataFrame, key: str, html: str, base: str = "https://portal.example.org",
                label_limit: int | None = None, value_limit: int | None = None) -> DataFrame:
    """Pages to ``(key, all_labels, fields, documents, notificaciones)``.

    Labels and values are whole; the limits (published widths: 120 and 500) are an option.
    """
    cut = cut_pages(pages, key, html)
    d = cut.select(key, labels_of(F.col("pairs"), label_limit).alias("all_labels"), documents_of(F.col("rows"), base).alias("documents"),
                   notices_of(F.col("rows")).alias("notificaciones"))
    return d.select(key, "all_labels", fields_of(F.col("all_labels"), value_limit).alias("fields"), "documents", "notificaciones")


def page_fields(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.explode("all_labels").alias("etiqueta", "valor"))


def page_documents(parsed: DataFrame, key: str) -> DataFrame:
    """Documents of a notice, one row per name (the first capture of a name wins)."""
    return parsed.select(key, F.explode("documents").alias("d")).select(key, "d.name", "d.url")


def page_notices(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.explode("notificaciones").alias("n")).select(key, "n.*")
