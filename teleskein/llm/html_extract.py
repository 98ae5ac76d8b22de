"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: too many
linked characters, a copyright sign or too few stop words make it bad; long text of many stop words
makes it good; what is short or between the thresholds stays open. In the second pass open blocks
inherit from the nearest decided blocks before and after them: two equal labels decide, between a
good and a bad one a nearly good block is good and a short one goes with the side that a nearly good
block stands next to, else with the bad; page ends count as bad. A heading close above a good block
is good.

Defined results: a null page has null text and no blocks; an empty or text-free page has empty text;
ids may be null or repeat, each row is read by itself; comments, scripts and the like that are never
closed reach to the end of the page; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

LINKS = 0.2
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.25, 0.32
#: A heading is kept if a good block begins within so many characters after it.
HEADING_REACH = 200

STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could do first for from had has have he her his how i if in into is it its just
    like made many may me more most my no not now of on one only or other our out over said same see she should so some such than that the their them then
    there these they this those through time to two up use very was way we well were what when where which who will with would you your
    au aussi autre aux avec avoir bien c ce ces cette comme d dans de des deux donc du elle en encore est et fait il ils j je l la le les leur lui mais même moi n ne nous on
    ont ou où par pas peu plus pour qu que qui s sa sans se ses si son sont sous sur tout très tu un une vous y été être
    aber alle als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für gegen haben hat hatte ich ihm ihn ihr im in ist
    ja kann kein mehr mit nach nicht noch nur ob oder sehr sein sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur
    al algo antes aquí así cada casi como con contra cual cuando del desde donde dos el ella ellos entre era es esa ese esta este esto está fue ha hace hasta hay la las le lo
    los me mi muy nada ni no nos o otra otro para pero poco por porque que qué quien se ser si sin sobre su sus también tan te tiene todo un una uno y ya yo más sí él
    """.split()
)
BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_HIDDEN = "script|style|noscript|template|iframe|object|svg|math|head|title"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<hidden>{_HIDDEN})\b(?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*+>.*?(?:</(?P=hidden)\s*+>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9]*)(?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*+>|<[!?/][^<>]*+>""", re.I | re.S)
_WORD = re.compile(r"\w+")
_HEADING = re.compile("h[1-6]")
OUT = "text string, n_blocks int, n_good int, blocks array<struct<text:string,heading:boolean,link_density:double,stop_density:double,first:string,label:string>>"


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, linked characters, whether it is a heading) of each block that has text."""
    out: list[tuple[str, int, bool]] = []
    pieces: list[tuple[str, bool]] = []
    link = heading = broke = False
    at = 0

    def finish():
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(p for p, is_link in pieces if is_link)).split())) if any(x for _, x in pieces) else 0
                out.append((text, min(linked, len(text)), heading))
            pieces.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append((piece, link))
            broke = broke and piece.isspace()
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "br":
            if broke:
                finish()
            else:
                pieces.append((" ", False))
            broke = True
        elif tag in BLOCK:
            finish()
            broke = link = False
            heading = not m["end"] and bool(_HEADING.fullmatch(tag))
        elif tag == "a":
            link = not m["end"]
    if at < len(page):
        pieces.append((page[at:], link))
    finish()
    return out


def first_pass(text: str, linked: int) -> tuple[str, float, float]:
    """(bad, short, near or good; link density; stop-word density)."""
    words = _WORD.findall(text.lower())
    links = linked / len(text)
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if links > LINKS or "©" in text:
        return "bad", links, stops
    if len(text) < SHORT:
        return ("bad" if linked else "short"), links, stops
    if stops >= STOPS_HIGH:
        return ("good" if len(text) > LONG else "near"), links, stops
    return ("near" if stops >= STOPS_LOW else "bad"), links, stops


def second_pass(first: list[str], lengths: list[int], heading: list[bool]) -> list[str]:
    """good or bad for each block."""
    n = len(first)
    known = list(first)
    reach = HEADING_REACH + 1
    for i in range(n - 1, -1, -1):  # characters from here to the next good block
        if first[i] == "good":
            reach = 0
        else:
            if heading[i] and first[i] in ("short", "near") and reach <= HEADING_REACH:
                known[i] = "near" if first[i] == "short" else first[i]
            reach += lengths[i]
    before, after = ["bad"] * n, ["bad"] * n
    near_before, near_after = [False] * n, [False] * n
    last, near = "bad", False
    for i in range(n):
        before[i], near_before[i] = last, near
        if known[i] in ("good", "bad"):
            last, near = known[i], False
        elif known[i] == "near":
            near = True
    last, near = "bad", False
    for i in range(n - 1, -1, -1):
        after[i], near_after[i] = last, near
        if known[i] in ("good", "bad"):
            last, near = known[i], False
        elif known[i] == "near":
            near = True
    out = []
    for i in range(n):
        if known[i] in ("good", "bad"):
            out.append(known[i])
        elif before[i] == after[i]:
            out.append(before[i])
        elif known[i] == "near":
            out.append("good")
        else:
            out.append("good" if (before[i] == "bad" and near_before[i]) or (after[i] == "bad" and near_after[i]) else "bad")
    return out


def read_page(page: str) -> list[dict]:
    found = blocks(page)
    seen = [first_pass(text, linked) for text, linked, _ in found]
    label = second_pass([s[0] for s in seen], [len(f[0]) for f in found], [f[2] for f in found])
    return [{"text": f[0], "heading": f[2], "link_density": round(s[1], 4), "stop_density": round(s[2], 4), "first": s[0], "label": x} for f, s, x in zip(found, seen, label)]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row for each page: id, its good blocks as text (a line each), their number and that of all, and every block with its labels."""
    shape = pa.list_(pa.struct([("text", pa.string()), ("heading", pa.bool_()), ("link_density", pa.float64()), ("stop_density", pa.float64()), ("first", pa.string()), ("label", pa.string())]))

    def run(batches):
        for batch in _text.slices(batches, "_text"):
            found = [None if page is None else read_page(page) for page in batch.column("_text").to_pylist()]
            good = [None if f is None else [b["text"] for b in f if b["label"] == "good"] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([None if g is None else "\n".join(g) for g in good], pa.string()), pa.array([len(f or []) for f in found], pa.int32()), pa.array([len(g or []) for g in good], pa.int32()), pa.array([f or [] for f in found], shape)],
                [id_col, "text", "n_blocks", "n_good", "blocks"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_text")).mapInArrow(_spark.frugal(run), f"{_spark.quoted(id_col)} {kind}, {OUT}")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(_spark.read(spark, sf_dir, "pages"))
