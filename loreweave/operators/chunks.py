"""From files to chunks: elements, chunks by title, chunks by meaning, pages."""

from __future__ import annotations

import re
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK = "array<struct<chunk_ix: int, section: string, type: string, page: int, page_end: int, text: string>>"
_ENDS = re.compile(r"[.!?:;,]$")
_RULE = re.compile(r"\|[\s\-|:]+\|")
_SENTENCE = re.compile(r"(?<=[.!?])(?=\s)|(?<=\n)")
_WORD = re.compile(r"\w+")


def elements(text: str) -> list[tuple[str, str, int]]:
    """(category, text, page) of each paragraph: Title, Table or NarrativeText; a form feed starts a page.

    A title is a markdown header, or one line of at most 80 characters and 12
    words that starts with a capital and has no mark at its end. Lines that
    start with a bar are a table where there are two of them and a separator.
    """
    out = []
    for page, sheet in enumerate(text.split("\f"), 1):
        lines = [x.strip() for x in sheet.split("\n")]
        kinds = ["" if not x else "#" if re.match("#{1,3} ", x) else "|" if x.startswith("|") else "a" for x in lines]
        for kind, group in groupby(zip(kinds, lines, strict=True), key=lambda x: x[0]):
            own = [x for _, x in group]
            if kind == "#":
                out += [("Title", x.lstrip("# "), page) for x in own]
            elif kind == "|" and len(own) >= 2 and any(_RULE.match(x) for x in own):
                out.append(("Table", "\n".join(own), page))
            elif kind:
                title = len(own) == 1 and len(own[0]) <= 80 and len(own[0].split()) <= 12 and own[0][0].isupper() and not _ENDS.search(own[0])
                out.append(("Title" if title else "NarrativeText", "\n".join(own), page))
    return out


def by_title(text: str, most: int = 2000, soft: int = 1800, join_under: int = 200) -> list[dict]:
    """Chunks of whole elements: a title starts one, and so does an element that would pass ``most`` or comes after ``soft`` characters.

    A section of fewer than ``join_under`` characters is joined with the next;
    tables stand alone; an element over ``most`` is cut at white space. Pages
    don't end a chunk.
    """
    out: list[dict] = []
    now: list[tuple[str, str, int]] = []
    section, start = "General", "General"
    size = lambda: sum(len(x[1]) for x in now) + 2 * max(0, len(now) - 1)

    def flush() -> None:
        if now:
            out.append({"section": start, "type": "CompositeElement", "page": now[0][2], "page_end": now[-1][2], "text": "\n\n".join(x[1] for x in now)})
            now.clear()

    for kind, x, page in elements(text):
        if kind == "Title":
            if size() >= join_under:
                flush()
            section = x
        if kind == "Table":
            flush()
            out.append({"section": section, "type": "Table", "page": page, "page_end": page, "text": x})
            continue
        while len(x) > most:
            flush()
            cut = max(x.rfind(" ", 0, most), x.rfind("\n", 0, most))
            cut = cut if cut > 0 else most
            out.append({"section": section, "type": "CompositeElement", "page": page, "page_end": page, "text": x[:cut].rstrip()})
            x = x[cut:].lstrip()
        if now and (size() + 2 + len(x) > most or size() >= soft):
            flush()
        if not now:
            start = section
        if x:
            now.append((kind, x, page))
    flush()
    return out


def by_meaning(text: str, most_tokens: int = 512, alike: float = 0.5) -> list[str]:
    """Runs of sentences: one ends where the next sentence is unlike it or it would have over ``most_tokens`` words.

    Offline stand-in for an embedding: cosine of hashed word counts. Joined,
    the parts are the text.
    """
    parts = []
    for x in _SENTENCE.split(text):
        # a sentence of too many words is cut between them
        edges = [0, *[m.start() for k, m in enumerate(_WORD.finditer(x)) if k and k % most_tokens == 0], len(x)]
        parts += [x[a:z] for a, z in pairwise(edges) if z > a]
    out: list[str] = []
    now, total, words = "", np.zeros(256), 0
    for s in parts:
        own = _WORD.findall(s.lower())
        v = np.bincount([sum(w.encode()) % 256 for w in own], minlength=256).astype(float) if own else np.zeros(256)
        norm = np.linalg.norm(v) * np.linalg.norm(total)
        if now and words + len(own) > most_tokens or (now and norm > 0 and v @ total / norm < alike):
            out.append(now)
            now, total, words = "", np.zeros(256), 0
        now, total, words = now + s, total + v, words + len(own)
    return [*out, now] if now else out


def title_chunks(docs: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """One row for each chunk: the columns of ``docs`` but its text, then chunk_ix, section, type, page, page_end, page_range, period, text. Nothing is shuffled."""

    @F.arrow_udf(CHUNK)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("chunk_ix", pa.int32()), ("section", pa.string()), ("type", pa.string()), ("page", pa.int32()), ("page_end", pa.int32()), ("text", pa.string())]))
        return pa.array([[{"chunk_ix": i} | c for i, c in enumerate(by_title(t or "", **limits))] for t in texts.to_pylist()], kind)

    rest = [c for c in docs.columns if c != text and c not in ("chunk_ix", "section", "type", "page", "page_end", "page_range", "period")]
    made = docs.select(*rest, F.explode(run(F.col(text))).alias("c")).select(*rest, "c.chunk_ix", "c.section", "c.type", "c.page", "c.page_end", "c.text")
    return made.withColumn("page_range", T.page_range(F.col("page"), F.col("page_end"))).withColumn("period", T.period(F.col("section")))


def semantic_chunks(chunks: DataFrame, over: int = 600, most_tokens: int = 512, alike: float = 0.5) -> DataFrame:
    """Chunks with text of over ``over`` characters divided by meaning: ``chunk_id`` is i, or i_j for the j-th part. Tables stay whole."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([by_meaning(t, most_tokens, alike) if t else [t] for t in texts.to_pylist()], pa.list_(pa.string()))

    long = (F.col("type") != "Table") & (F.length("text") > over)
    parts = F.when(long, run(F.when(long, F.col("text")))).otherwise(F.array("text"))
    rest = [c for c in chunks.columns if c != "text"]
    out = chunks.withColumn("__parts", parts).select(*rest, F.size("__parts").alias("__n"), F.posexplode("__parts").alias("__j", "text"))
    name = F.when(F.col("__n") > 1, F.concat_ws("_", F.col("chunk_ix").cast("string"), F.col("__j").cast("string"))).otherwise(F.col("chunk_ix").cast("string"))
    return out.withColumn("chunk_id", name).drop("__n", "__j")


def page_rows(parsed: DataFrame, label: Column, text: Column) -> DataFrame:
    """Pages of a parser's result: the label as a number (1 where it is none), section, period and kind of each; empty pages go."""
    body = F.trim(text)
    kept = parsed.withColumn("page", F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(label.cast("string"), r"^\s*(\d{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))).withColumn("text", body).where(F.length("text") > 0)
    table = T.is_markdown_table(F.col("text"))
    kept = kept.withColumn("section", T.section(F.col("text"))).withColumn("period", T.period(F.col("section")))
    return kept.withColumn("type", F.when(table, "Table").otherwise("NarrativeText")).withColumn("is_authoritative", F.when(table, True)).withColumn("table_markdown", F.when(table, F.col("text")))


def raw_text(pages: DataFrame, per: str, order: str, separator: str = "\n\n") -> DataFrame:
    """The pages of each document as one text, in order."""
    return pages.groupBy(per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), separator).alias("raw_text"))
