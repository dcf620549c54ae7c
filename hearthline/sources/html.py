"""Text, label-value pairs and embedded JSON of HTML pages, through the standard library's parser, by slices of Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_BLOCKS = {"p", "li", "dd", "dt", "div", "span"}
_CELLS = {"td", "th"}
_TOLD = _BLOCKS | _CELLS
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_FACTS = re.compile(r"fact|key|info", re.IGNORECASE)
#: Keys of an object whose value stands for it.
VALUE_KEYS = ("value", "amount", "amountvalue", "amount_value", "raw", "rawvalue", "raw_value", "number", "price", "pricevalue", "price_value", "formatted", "formattedvalue")
SCHEMA = "rows array<string>, blocks array<string>, pairs array<struct<label:string,value:string,pos:int>>, json array<string>"


def _tidy(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


class _Page(HTMLParser):
    """Open elements, each with the place where its text begins; what closes is filed by its kind."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.rows: list[list[str]] = []
        self.blocks: list[tuple[int, str]] = []
        self.lists: list[tuple[list[str], list[str]]] = []
        self.facts: list[str] = []
        self.json: list[str] = []
        self.state: list[str] = []
        self.marks: dict[str, str] = {}
        self.parts: list[str] = []
        self.count = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _VOID:
            self._mark(tag, a)
            return
        self.count += 1
        is_json = None if tag != "script" else self.json if a.get("type") == "application/ld+json" else self.state if a.get("id") == "__NEXT_DATA__" else None
        fact = bool(_FACTS.search(a.get("class") or "") or "facts" in (a.get("data-testid") or ""))
        self.open.append({"tag": tag, "n": self.count, "at": len(self.parts), "text": [], "cells": [], "dt": [], "dd": [], "json": is_json, "fact": fact, "address": a.get("data-testid") == "object-address"})

    def _mark(self, tag: str, a: dict[str, str]) -> None:
        """Images that the head or a gallery names, the first of each kind."""
        name = a.get("property") or a.get("name") or ""
        if tag == "meta" and name in ("og:image", "twitter:image") and a.get("content"):
            self.marks.setdefault(name, a["content"])
        if tag == "img" and a.get("src") and (a.get("data-testid") == "gallery-image" or "images" in a["src"]):
            self.marks.setdefault("gallery", a["src"])

    def handle_data(self, data):
        hidden = next((e for e in reversed(self.open) if e["tag"] in ("script", "style")), None)
        (hidden["text"] if hidden else self.parts).append(data)

    def handle_endtag(self, tag):
        if not any(e["tag"] == tag for e in self.open):
            return
        while self.open:
            e = self.open.pop()
            self._file(e)
            if e["tag"] == tag:
                return

    def _file(self, e: dict) -> None:
        tag = e["tag"]
        text = _tidy(self.parts[e["at"] :]) if tag in _TOLD or e["address"] else ""
        inside = {x["tag"] for x in self.open}
        if e["json"] is not None:
            e["json"].append("".join(e["text"]))
        if e["address"]:
            self.marks.setdefault("address", text)
        if tag in _CELLS:
            for x in reversed(self.open):
                if x["tag"] == "tr":
                    x["cells"].append(text)
                    break
        if tag == "tr" and "table" in inside:
            self.rows.append(e["cells"])
        if tag in ("dt", "dd"):
            for x in reversed(self.open):
                if x["tag"] == "dl":
                    x[tag].append(text)
                    break
        if tag == "dl":
            self.lists.append((e["dt"], e["dd"]))
        if tag in _BLOCKS and "table" not in inside and text:
            self.blocks.append((e["n"], text))
            if tag in ("li", "div", "span") and any(x["fact"] for x in self.open):
                self.facts.append(text)

    def close(self):
        super().close()
        while self.open:
            self._file(self.open.pop())


def _key_value(text: str) -> tuple[str, str] | None:
    m = re.match(r"\s*([^:]{3,}):\s*(.+)\s*$", text)
    return (m.group(1).strip(), m.group(2).strip()) if m else None


def _valid(documents: list[str]) -> list[str]:
    out = []
    for raw in documents:
        try:
            out.append(json.dumps(json.loads(raw), ensure_ascii=False))
        except ValueError:
            continue
    return out


def _parsed(html: str | None) -> tuple[_Page, dict[str, str]]:
    """The page, and its label-value pairs: of lists, table rows and facts, the first of each label."""
    page = _Page()
    page.feed(html or "")
    page.close()
    pairs: dict[str, str] = {}
    found = [p for dt, dd in page.lists if len(dt) == len(dd) for p in zip(dt, dd, strict=True)]
    found += [(r[0], r[1]) for r in page.rows if len(r) >= 2] + [kv for t in page.facts if (kv := _key_value(t))]
    for label, value in found:
        if label and value:
            pairs.setdefault(label, value)
    return page, pairs


def read_page(html: str | None) -> dict:
    page, pairs = _parsed(html)
    rows = [t for r in page.rows if (t := _tidy(r))]
    listed = [{"label": k, "value": v, "pos": i} for i, (k, v) in enumerate(pairs.items())]
    return {"rows": rows, "blocks": [t for _, t in sorted(page.blocks)], "pairs": listed, "json": _valid(page.json + page.state)}


def read_listing(html: str | None) -> dict:
    """What a listing is projected from: labels, entries of the embedded JSON (linked data first), marked images and address, and the text."""
    page, pairs = _parsed(html)
    linked, state = _valid(page.json), _valid(page.state[:1])
    return {
        "labels": [{"label": k, "value": v, "pos": i} for i, (k, v) in enumerate(pairs.items())], "pairs": [{"key": plain_key(k), "value": v} for k, v in pairs.items()],
        "entries": json_entries(linked + state, len(linked)), "marks": page.marks, "text": " ".join(t for x in page.parts if (t := x.strip())),
    }


#: Rows and characters of HTML whose results are Python's objects at one time.
SLICE_ROWS, SLICE_CHARS = 64, 1 << 20


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows within both bounds; a longer page stands alone."""
    begin = total = 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin == SLICE_ROWS or total + n > SLICE_CHARS):
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def _with_read(pages: DataFrame, column: str, read, schema: str, kept: list[str]) -> DataFrame:
    """The kept columns with what read makes of each page, a slice at a time: memory doesn't grow with the rows of a batch."""
    fields = StructType.fromDDL(schema)
    types = to_arrow_schema(fields)
    rows = pages.select(*kept, F.col(column).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(len(kept))), 0).to_pylist()
            for i, j in _slices(lengths):
                part = batch.slice(i, j - i)
                found = [read(h) for h in part.column(len(kept)).to_pylist()]
                made = [pa.array([list(r[t.name].items()) if pa.types.is_map(t.type) else r[t.name] for r in found], t.type) for t in types]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=[*kept, *types.names])

    return rows.mapInArrow(run, StructType([*rows.select(*kept).schema.fields, *fields.fields]))


def with_content(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with rows, blocks, pairs (label, value, pos; the first of each label) and json (valid embedded documents)."""
    return _with_read(pages, column, read_page, SCHEMA, pages.columns)


def with_listing(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the column, with labels (label, value, pos), pairs (plain key, value), entries, marks (og:image, twitter:image, gallery, address) and text."""
    return _with_read(pages, column, read_listing, LISTING, [c for c in pages.columns if c != column])


def segments(pages: DataFrame, key: str, source: str) -> DataFrame:
    """key, pos, text, source: table rows, then text blocks outside tables, each text once whatever its case."""
    each = with_content(pages).select(key, F.posexplode(F.concat("rows", "blocks")).alias("pos", "text"))
    first = each.groupBy(key, F.lower("text").alias("_l")).agg(F.min(F.struct("pos", "text")).alias("f"))
    return first.select(key, "f.pos", "f.text", F.lit(source).alias("source"))


ENTRIES = "array<struct<obj:int,up:string,depth:int,linked:boolean,key:string,value:string,number:boolean>>"
LISTING = f"labels array<struct<label:string,value:string,pos:int>>, pairs array<struct<key:string,value:string>>, entries {ENTRIES}, marks map<string,string>, text string"


def plain_key(text: str) -> str:
    """Lower-case words of a-z and 0-9, marks dropped."""
    base = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", base.lower()).strip()


def _first_scalar(node):
    """The node itself, or what stands for it: an object's first VALUE_KEYS, a list's first items."""
    waiting = [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, (str, int, float)):
            return x
        inner = [x[k] for k in VALUE_KEYS if k in x] if isinstance(x, dict) else x if isinstance(x, list) else []
        waiting += reversed(inner)
    return None


def json_entries(documents: list[str] | None, linked: int = 0) -> list[dict]:
    """Every entry of every object, in reading order: the object's number, the key that the object stands under and its depth, whether
    it is among the first documents (those of linked data), the entry's key and its scalar (null if it has none), and whether that is a number.
    """
    out, objects = [], 0
    every = list(documents) if documents is not None else []
    waiting = [(None, "", 0, i < linked, None, json.loads(d)) for i, d in reversed(list(enumerate(every)))]
    while waiting:
        obj, up, depth, first, key, node = waiting.pop()
        if key is not None:
            value, plain = _first_scalar(node), plain_key(key)
            out.append({"obj": obj, "up": up, "depth": depth, "linked": first, "key": plain, "value": None if value is None else str(value), "number": isinstance(value, (int, float))})
            up = plain
        if isinstance(node, dict):
            objects += 1
            waiting += [(objects, up, depth + 1, first, k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            waiting += [(None, up, depth, first, None, v) for v in reversed(node)]
    return out


def entries(documents: Column) -> Column:
    """ENTRIES of an array of JSON documents, each parsed once for all fields that are looked up."""

    @F.pandas_udf(ENTRIES)
    def read(docs: pd.Series) -> pd.Series:
        return pd.Series([json_entries(d) for d in docs], dtype=object)

    return read(documents)


def names_match(key: Column, *names: str) -> Column:
    """Whether a plain key holds one of the names, written together, or all of its words."""
    hit, together, words = F.lit(False), F.replace(key, F.lit(" "), F.lit("")), F.split(key, " ")
    for name in map(plain_key, names):
        hit = hit | F.contains(together, F.lit(name.replace(" ", ""))) | (F.size(F.array_except(F.lit(name.split()), words)) == 0)
    return hit


def first_named(found: Column, *names: str) -> Column:
    """The value of the first of the entries (key, value) under one of the names that has one."""
    return F.try_element_at(F.filter(found, lambda e: e["value"].isNotNull() & names_match(e["key"], *names)), F.lit(1))["value"]


def json_value(documents: Column, *names: str) -> Column:
    """The first scalar, as text, under one of the names anywhere in an array of JSON documents."""
    return first_named(entries(documents), *names)
