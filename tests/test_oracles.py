import html
import re

import pytest

from caselake.operators import segment
from caselake.plans import registry
from tests.conftest import SMALL
from tests.oracle import compare, connect
from tests.shapes import shapes


def html_by_hand(page):
    h = page or ""
    if re.search("<td|<table", h, re.I):
        h = re.sub(r"</tr>\s*", "\n", re.sub(r"</t[dh]>\s*", " | ", h, flags=re.I), flags=re.I)
    h = re.sub(r"</(p|div|h[1-6]|li)>", "\n", re.sub(r"<br\s*/?>", "\n", h, flags=re.I), flags=re.I)
    lines = (re.sub(r"\s*\|\s*", " | ", x.strip()).strip() for x in html.unescape(re.sub("<[^>]+>", "", h)).split("\n"))
    return [x for x in (re.sub(r"^\|\s*|\s*\|$", "", x).strip() for x in lines) if x]


def html_rows(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()
    return [(r["page_id"], i, x) for r in pages for i, x in enumerate(html_by_hand(r["html"]))]


def chunk_rows(spark):
    """Every character of a text is in one chunk, but for white space; each cut is the latest allowed one."""
    out = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        t, at, i = r["text"] or "", 0, 0
        while at < len(t):
            end = at + segment.CHUNK
            if end < len(t):
                cuts = [k + 1 for k in range(at + segment.CHUNK // 2, end) if t[k] == "\n" or t[k : k + 2] == ". "]
                end = cuts[-1] if cuts else end
            end = min(end, len(t))
            if t[at:end].strip():
                out.append((r["doc_id"], i, None, at, end, t[at:end]))
                i += 1
            at = end
    return out


def mutual_rows(spark):
    import numpy as np

    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    a, b = ([(i, v / np.linalg.norm(v)) for i, v in sorted(rows, key=lambda r: r[0]) if (i % 20 == 0) == side] for side in (True, False))
    s = np.round(np.array([v for _, v in a]) @ np.array([v for _, v in b]).T, 6)
    pairs = {(a[i][0], b[int(s[i].argmax())][0]) for i in range(len(a))} | {(a[int(s[:, j].argmax())][0], b[j][0]) for j in range(len(b))}
    return list(pairs)


def shape_rows(spark):
    from caselake.plans import layouts

    out = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        found = shapes(list(enumerate((r["text"] or "").split("\n"))), set(layouts.LABELS))
        out += [(r["doc_id"], n, shape, None if c is None else " | ".join(c)) for n, shape, c in found]
    assert {x[2] for x in out} == {"row", "heading", "body"}
    return out


def recovered_rows(spark):
    """Customers' entries page by page, each second reading in turn, by the rules of likeness word for word."""
    import difflib

    alike = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    quality = lambda t: (n := sum(c.isalpha() and bool(re.match("[\u0621-\u064a]", c)) for c in t)) - 3 * len(re.findall("[0-9]", t)) - 0.05 * abs(len(t) - n)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    def entries(name, key, meaning, first):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet").collect()
        return [[first + r[key], r[key] % 40, r[key], f"k{r[key] * 7 % 97}", ("nom" if r[key] % 3 == 0 else "name") + f"{r[key] % 5}ra", "meaning of " + meaning(r), r[key] * 13 % 400] for r in sorted(rows, key=lambda r: r[key])]

    old = entries("customer", "c_custkey", lambda r: r["c_mktsegment"].lower(), 0)
    new = entries("supplier", "s_suppkey", lambda r: ("building", "machinery", "householt")[r["s_nationkey"] % 3], 10**9)
    known, taken, out = {(r[1], r[3]) for r in old}, {}, []
    for r in new:
        if (r[1], r[3]) in known:
            continue
        known.add((r[1], r[3]))
        for o in old:
            if o[1] == r[1] and o[0] not in taken and abs(o[6] - r[6]) <= 55:
                names, meanings = alike(o[4], r[4]), alike(o[5], r[5])
                if edits(o[4], r[4]) <= 2 and names >= 0.68 and meanings >= 0.65 or names >= 0.5 and meanings >= 0.84:
                    taken[o[0]] = r
                    break
        else:
            out.append((r[0], r[1], r[3], r[4], r[5], "added"))
    for o in old:
        r = taken.get(o[0])
        out.append((o[0], o[1], r[3], r[4], r[5] if quality(r[5]) > quality(o[5]) else o[5], "corrected") if r else (o[0], o[1], o[3], o[4], o[5], "read"))
    return out


#: What the queries without SQL give, by plain loops.
BY_HAND = {"line_shapes": shape_rows, "recovered_entries": recovered_rows, "html_lines": html_rows, "document_chunks": chunk_rows, "vector_mutual_all": mutual_rows}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLES:
        compare(spark, connect(SMALL), SMALL, registry.QUERIES[name], registry.ORACLES[name])
    else:
        got = [tuple(r) for r in registry.QUERIES[name](spark, SMALL).collect()]
        assert sorted(got, key=repr) == sorted(BY_HAND[name](spark), key=repr) and got
